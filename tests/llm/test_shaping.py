"""Fill-in-middle, token counts and filter audit against the library, brute force and exact round trips."""

import hashlib
import random
import re
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparksci.llm import fill_in_middle, filter_audit, token_count
from sparksci.llm.bpe import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, words string, good boolean"
LONG = "word " * 40_000
TEXTS = [None, "", " ", "word", "Same text here twice", "Same text here twice", "é中文 ñandú\nline two\n\nline four\n", "x" * 60_000, "<P>held", "a <|endoftext|> b<|endoftext|>", "cut <", "S> cut", "😀😀\t\t \n b", LONG, "<<P", "\n\n", "AAA bb # c"]


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns with clashing names."""
    data = [(i, t, "en" if i % 2 else None, f"s{i % 3}", 7, "f", "w", True) for i, t in enumerate(TEXTS)]
    data += [data[4], data[13], (None, "a row without id", None, None, None, None, None, None), (None, "Same text here twice", "de", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op11 --------------------------------------------------------------------------------------


def units_by_hand(text, unit):
    if unit == "code_point":
        return list(text)
    out = []
    for c in text:
        if unit == "line":
            new = not out or out[-1].endswith("\n")
        else:
            new = not out or (out[-1][-1] in " \t\n\x0b\f\r") != (c in " \t\n\x0b\f\r")
        out = [*out, c] if new else [*out[:-1], out[-1] + c]
    return out


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_rank_lookup_equals_units_one_by_one(unit):
    scan, rng = fill_in_middle.EventScan(unit), random.Random(3)
    texts = ["", " ", "\n", "a", "a\n", " a", "a  b \n\n c"] + ["".join(rng.choice("ab é\n\t中 ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text in texts:
        ranks = fill_in_middle.Ranks(scan, scan.events(text)[0], len(text))
        units = units_by_hand(text, unit)
        assert ranks.total == len(units), (unit, text)
        assert [ranks.offset(k) for k in range(len(units) + 1)] == [sum(map(len, units[:k])) for k in range(len(units) + 1)]


def by_hand(doc_id, text):
    text, d = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_transformation_equals_cutting_by_hand(spark, odd):
    more = spark.createDataFrame([(i, random.Random(i).choice(["ab <", "S> x\n", "<P>"]) * (i % 9)) for i in range(100, 500)], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    made = fill_in_middle.fill_in_middle(df)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in rows(made)), key=repr)
    texts = [(r["doc_id"], r["text"]) for r in rows(df)]
    assert got == sorted(((i, *by_hand(i, t)) for i, t in texts), key=repr)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    back = sorted(((r["doc_id"], r["restored"]) for r in rows(fill_in_middle.restored(made))), key=repr)
    assert back == sorted(((i, t or "") for i, t in texts), key=repr)


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_round_trip(spark, odd, unit):
    made = fill_in_middle.fill_in_middle(odd, unit=unit, sentinels=("<|pre|>", "<|suf|>", "<|mid|>"), seed=5)
    assert sorted((r["restored"] for r in rows(fill_in_middle.restored(made, sentinels=("<|pre|>", "<|suf|>", "<|mid|>"))))) == sorted(r["text"] or "" for r in rows(odd))
    assert all(r["prefix_units"] + r["middle_units"] <= r["n"] for r in rows(made) if r["form"] != "plain")


def test_wrong_arguments_and_outputs_are_refused(spark, empty):
    for wrong in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d"), ("a b", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.EventScan(sentinels=wrong)
    with pytest.raises(ValueError):
        fill_in_middle.EventScan("syllable")
    for output, form in (("<P>a<M>b<S>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("text", "spm"), ("a", "other")):
        with pytest.raises(ValueError):
            fill_in_middle.restore(fill_in_middle.EventScan(), output, form)
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(empty)).count() == 0


# --- op12 --------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, odd, sf):
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows(docs)), key=repr)
    got = rows(token_count.count_tokens(docs))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got) and any(r["over_limit"] for r in got)


def test_counts_of_random_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 4000)  # memories change over many times
    counter, library, rng = token_count.Counter(Path(VOCABULARY).read_text()), Tokenizer.from_file(VOCABULARY), random.Random(8)
    for _ in range(40):
        texts = ["".join(rng.choice(["a", "b", "th", "e", " ", "  ", "\n", "é", "中", "1", "'s", "<|endoftext|>", "A", "aaaa"]) for _ in range(rng.randint(0, 200))) for _ in range(20)]
        assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.merges(b"") == 0


def test_token_counts_of_nothing(empty):
    assert token_count.count_tokens(empty).count() == 0


# --- op13 --------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    """Every order applied to every document, one after the other."""
    said = {}
    for i, q, t in labels:
        good, toxic = said.get(i, (False, False))
        said[i] = (good or q == 1, toxic or t == 1)
    seen = {}
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    judged = []
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and seen[t] < i}
        judged.append((lang or "", fails, *(said.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {p for p, *_ in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[0][f]]
                left = [j for j in left if not j[0][f]]
                shapley[f] += len(gone)
                all_fail = sum(j[0][f] for j in mine)
                out[part, order, step] = [len(left), len(gone), all_fail - len(gone), sum(j[0][f] and sum(j[0].values()) == 1 for j in mine), sum(j[1] for j in gone), sum(j[2] for j in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = rows(df)
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_equals_applying_every_order(spark):
    rng = random.Random(2)
    texts = ["", None, " ", "a b", "A B #", "x " * 250, " ".join(f"w{k}" for k in range(220)), "W" + " ".join(f"w{k}" for k in range(220)) + " $ |"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(200)]
    labels = [(rng.randint(0, 60), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)] + [(None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("words", F.lit(3))
    got = audited(filter_audit.audit(df.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audit_by_hand(docs, labels)


def test_audit_of_odd_rows_and_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audited(filter_audit.audit(odd, none))
    assert got == audit_by_hand([(r["doc_id"], r["text"], r["lang"]) for r in rows(odd)], [])
    assert {p for p, *_ in got} == {"", "en", "de"} and len(got) == 3 * 600
    assert filter_audit.audit(empty, none).count() == 0


def test_repeated_rows_divide_out_of_word_totals(spark):
    df = spark.createDataFrame([(1, "a b a")] * 7 + [(1, "c"), (2, " \n"), (None, "a a"), (None, "a a")], "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["words"], r["distinct_words"]) for r in rows(filter_audit.word_totals(df))), key=repr)
    assert got == sorted([(1, 3, 2), (1, 1, 1), (None, 2, 1)], key=repr)
