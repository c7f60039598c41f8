"""The pipeline against a brute-force version of each stage."""

import hashlib
import random
import re

import corpus_pipeline
from sparksci.llm import near_dedup

BLANKS = "\x20\x09-\x0d"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(f"[^{BLANKS}]+", (text or "").translate(UPPER))


def shingles(text, width):
    w = words(text)
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def groups(docs, width, percent=80):
    """{doc_id: least id reachable} by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    label = {i: i for i in docs}
    links = [
        (i, j)
        for i in docs
        for j in docs
        if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            moved |= label[i] != label[j]
            label[i] = label[j] = low
    return label


def dropped(docs, least=3):
    """Texts without the repeated lines, by counting them in a dictionary."""
    held = {}
    strip = " \t\n\x0b\f\r"
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            key = line.strip(strip).translate(UPPER)
            if len(key) >= 20:
                held.setdefault(key, set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= least}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(x.strip(strip).translate(UPPER), i) == i) for i, t in docs.items()}


BASE = [" ".join(f"word{(7 * k + 13 * j) % 997}x{k}" for j in range(120)) for k in range(6)]


def corpus():
    rows = {}
    for k, text in enumerate(BASE):
        rows[10 * k] = text
        rows[10 * k + 1] = text
        rows[10 * k + 2] = text + " tail"
        rows[10 * k + 3] = " ".join(text.split()[::-1])
    shared = "This very line is found in several documents."
    for k in range(4):
        rows[200 + k] = f"{shared}\nown line number {k} of this document {k * 7919}"
    rows[300] = "1234 5678 !!!"
    rows[301] = ""
    rows[302] = None
    rows[303] = "word"
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")


def test_line_stage_equals_counting(spark):
    rows = corpus()
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, frame(spark, rows), "").collect()}
    assert got == dropped(rows)


def test_near_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    label = groups(rows, 5)
    out = corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in rows if label[i] == i)


def test_near_stage_keeps_one_of_each_group_without_ids(spark):
    base, alone = BASE[0], BASE[1]
    rows = [(5, base), (6, base + " tail"), (None, base + " end"), (None, alone), (None, alone + " tail"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == 4
    assert (5, base) in got and (None, "") in got and (None, None) in got and sum(t in (alone, alone + " tail") for _, t in got) == 1


def test_near_stage_keeps_one_of_repeated_rows_and_clashing_columns(spark):
    base, alone = BASE[0], BASE[1]
    data = [(5, base, 0, 1), (5, base, 1, 1), (5, alone, 2, 1), (6, base + " tail", 3, 1), (7, alone + " tail", 4, None), (8, "", 5, 1), (8, "", 6, 1), (None, alone, 7, 1), (9, None, 8, 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), r, x) for i, t, r, x in data], "doc_id long, text string, lang string, source string, n_chars long, row long, head int")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert out.columns == docs.columns
    assert got == sorted([(5, base), (5, alone), (8, ""), (8, ""), (9, None)], key=str)


def test_stages_take_odd_rows(spark):
    """Nulls in every column, repeated rows, clashing names and long texts in each stage."""
    long = "word " * 30_000 + "\n" + "a line that is longer than twenty letters\n" * 3
    data = [(1, "some plain words", "en", "s", 5), (1, "some plain words", "en", "s", 5), (None, "more plain words", None, None, None), (None, None, None, None, None), (2, long, "en", None, 7), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*x, "t", 1, 2.0) for x in data], "doc_id long, text string, lang string, source string, n_chars long, set string, task int, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    packed = corpus_pipeline.pack_into_sequences(spark, docs, "").collect()
    assert sum(r["n"] for r in packed if r["doc_id"] == 2) == len(long.split())


def test_near_duplicates_over_many_chunks_equal_all_pairs(spark, monkeypatch):
    """Buckets far larger than a chunk: copies of several bases that share bands, some links only across chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    rng = random.Random(6)
    rows = {}
    for k in range(3):
        base = [f"w{k}x{i}" for i in range(60)]
        for v in range(25):
            w = list(base)
            for j in range(rng.randint(0, 5)):
                w[rng.randrange(60)] = f"n{k}y{v}z{j}"
            rows[100 * k + v] = " ".join(w)
    label = groups(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect()}
    assert got == label


def test_near_duplicates_of_two_words_equal_all_pairs(spark):
    rows = corpus()
    label = groups(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect()}
    assert got == {i: (len(shingles(t, 2)), label[i]) for i, t in rows.items()}


def test_stages_follow_each_other(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    alive = {i: t for i, t in rows.items() if re.search("[a-z]", t or "")}
    texts = dropped(alive)
    label = groups(texts, 5)
    kept = {i for i in texts if label[i] == i}
    assert {r["doc_id"] for r in out} == kept
    size = {i: len(words(texts[i])) for i in kept}
    for i in kept:
        assert sum(r["n"] for r in out if r["doc_id"] == i) == size[i]
    bins = {}
    for r in out:
        if r["bin"] is not None:
            bins.setdefault(r["bin"], []).append(r)
    for held in bins.values():
        assert sum(r["n"] for r in held) <= 2048
        sources = [f"s{r['doc_id'] % 3}" for r in held]
        assert len(set(sources)) == len(sources)


def test_empty_table(spark, tmp_path):
    frame(spark, {0: "x"}).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_group_of_copies_costs_few_links(spark):
    """One base text and many variants that resemble the base more than each other."""
    words_ = [f"w{i}" for i in range(400)]
    rows = {}
    for k in range(60):
        w = list(words_)
        for j in range(14):
            w[(k * 29 + j * 31) % 400] = f"x{k}y{j}"
        rows[k + 1] = " ".join(w)
    rows[100] = " ".join(words_)
    label = groups(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect()}
    assert got == label
    assert hashlib.sha256(b"").hexdigest()  # digests are at hand for the queries
