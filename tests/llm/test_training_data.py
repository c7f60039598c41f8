"""Each operator against brute force, exact round trips or held-out accuracy; and its defined edge cases."""

import hashlib
import heapq
import json
import random
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparksci.llm import bpe, common, language_id, line_dedup, lm_score, near_dedup, ogg, packing, registry, sharding, topk, url_rules
from sparksci.sources import tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, key string"
TEXTS = [None, "", " ", "word", "Same text here twice", "Same text here twice", "é中文 ñandú\nline two\n\nline four", "x" * 60_000, "1234 !!", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i else None, None, 7, "big", "k") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "a row without id and with some words", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- op1 ---------------------------------------------------------------------------------------


def test_policy_longest_rule_wins(spark):
    urls = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://EXAMPLE.net/de/1?x#y": ("example.net", "/de/1", "net/", "block"),
        "https://net": ("net", "", None, "allow"),
        "https://w.example.com/de/x": ("w.example.com", "/de/x", "example.com/de/", "block"),
        "https://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
        "https://x.org/fr/2": ("x.org", "/fr/2", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "host?") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], url_rules.RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_rules.judge(pages, none))}
    assert got == dict(enumerate(urls.values()))


def test_mined_rules_block_what_holds_all_their_tokens(spark):
    bad = [(f"http://spam{i % 2}.test/win/{i}?promo=1", True) for i in range(60)]
    good = [(f"http://spam{i % 2}.test/news/{i}", False) for i in range(60)] + [(f"http://fine.test/win/{i}", False) for i in range(60)]
    labelled = spark.createDataFrame(bad + good, "url string, bad boolean")
    rules = url_rules.mine(labelled, 0.05, 0.9)
    sets = [(r["verdict"], set(r["tokens"])) for r in rows(rules)]
    assert {v for v, _ in sets} == {"block", "allow"} and all(r["confidence"] >= 0.9 for r in rows(rules))
    assert not any(a < b and v == w for v, a in sets for w, b in sets)  # shorter rules that are as sure replace longer ones
    data = [(1, "http://spam0.test/win/9?promo=2"), (2, "http://spam0.test/news/9"), (3, "http://fine.test/win/3"), (1, "http://spam0.test/win/9?promo=2"), (None, "http://spam1.test/win/8?promo=2"), (4, None)]
    got = rows(url_rules.judge(spark.createDataFrame(data, "page_id long, url string"), rules))
    assert sorted((r["page_id"] or 0, r["verdict"], r["mined"]) for r in got if r["page_id"] != 4) == [(0, "block", "block"), (1, "block", "block"), (1, "block", "block"), (2, "allow", "allow"), (3, "allow", "allow")]
    assert [(r["verdict"], r["mined"]) for r in got if r["page_id"] == 4] == [("allow", None)]


def test_mined_rules_equal_counting_all_token_sets(spark):
    rng = random.Random(4)
    labelled = []
    for i in range(400):
        parts = [rng.choice(["a", "bb", "cc"]), rng.choice(["shop", "blog"]), rng.choice(["en", "de"])]
        labelled.append((f"http://{parts[1]}.{parts[0]}x.org/{parts[2]}/{i}" + rng.choice(["", "?ref=1", "?page=2&ref=3"]), rng.random() < (0.7 if parts[:2] == ["bb", "shop"] else 0.2)))
    df = spark.createDataFrame(labelled, "url string, bad boolean")
    baskets = [(frozenset(t), b) for t, b in df.select(url_rules.tokens(F.col("url")), "bad").collect()]
    share = sum(b for _, b in baskets) / len(baskets)
    counts = {}
    for own, b in baskets:
        for k in range(1, len(own) + 1):
            for s in combinations(sorted(own), k):
                n, bad = counts.get(s, (0, 0))
                counts[s] = (n + 1, bad + b)
    found = {}
    for s, (n, bad) in counts.items():
        for verdict, m, base in (("block", bad, share), ("allow", n - bad, 1 - share)):
            if m >= 20 and m / n >= 0.5 and (m / n - base) / (base * (1 - base) / n) ** 0.5 >= 2:
                found[s, verdict] = m / n
    want = {(s, v): c for (s, v), c in found.items() if not any(w == v and set(x) < set(s) and d >= c for (x, w), d in found.items())}
    got = {(tuple(sorted(r["tokens"])), r["verdict"]): r["confidence"] for r in rows(url_rules.mine(df))}
    assert want and {v for _, v in want} == {"block", "allow"} and got == pytest.approx(want)


def test_mining_long_urls_and_nothing(spark, empty):
    long = [("http://a.test/" + "/".join(f"part{chr(97 + k)}x" for k in range(24)) + f"?i={i}", i % 4 == 0) for i in range(50)]
    rules = url_rules.mine(spark.createDataFrame(long + [("http://b.test/" + "y" * 50_000, True), (None, True), ("", None)], "url string, bad boolean"))
    # Every token is in the same rows: one rule each, of 24 path parts, the host's two labels and the query key.
    got = {tuple(r["tokens"]) for r in rows(rules) if r["verdict"] == "allow"}
    assert got == set() or all(len(t) == 1 for t in got)
    told = [(f"http://a{i % 2}.test/" + "/".join(f"part{chr(97 + k)}x" for k in range(20)) + ("/spam" if i % 2 else "/news"), i % 2 == 1) for i in range(60)]
    block = {tuple(r["tokens"]) for r in rows(url_rules.mine(spark.createDataFrame(told, "url string, bad boolean"))) if r["verdict"] == "block"}
    assert block == {("h:a1",), ("p:spam",)}  # the two tokens that only bad rows hold; twenty shared parts add nothing
    none = spark.createDataFrame([], "url string, bad boolean")
    assert url_rules.mine(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, verdict string")
    assert url_rules.judge(pages, url_rules.mine(none)).count() == 0
    labels = spark.createDataFrame([(1, None, None, "x"), (None, 0, 1, "x"), (2, 0, None, "x"), (2, 1, 0, "y")], "doc_id long, quality int, toxic int, url string")
    urls = spark.createDataFrame([("http://h/1",), ("http://h/2",), (None,), ("http://h/x",)], "url string")
    assert sorted((r["url"], r["bad"]) for r in rows(url_rules.labelled_urls(urls, labels))) == [("http://h/1", False), ("http://h/2", True)]


# --- op2 ---------------------------------------------------------------------------------------


def test_sharding_law(spark, odd):
    got = rows(sharding.shard_by_size(odd, 8))
    assert len(got) == odd.count()
    groups = {}
    for r in got:
        groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    for k in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert {r["text_crc32"] for r in got if r["size"] == 4 + 1} == {zlib.crc32(b"word")}


def plain_heap(sizes, shards):
    """Longest processing time by the book: every group by itself, largest first, to the least-loaded shard."""
    heap = [(0, k) for k in range(shards)]
    counts = {}
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, k))
        counts.setdefault(s, [0] * shards)[k] += 1
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_lpt_equals_a_plain_heap(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40 if seed % 2 else 5) for _ in range(500)] + [rng.randint(1, 10**7) for _ in range(seed * 10)] + [1000]
    assert sharding.lpt(list(Counter(sizes).items()), 8) == plain_heap(sizes, 8)


def test_lpt_after_a_hot_group_equals_a_plain_heap_and_takes_no_step_a_group():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randint(1, 3000) for _ in range(rng.randint(0, 3))] + [rng.choice([1, 2, 3, 7, 10]) for _ in range(rng.randint(0, 400))]
        shards = rng.randint(1, 9)
        assert sharding.lpt(list(Counter(sizes).items()), shards) == plain_heap(sizes, shards)
    began = time.perf_counter()
    got = sharding.lpt([(10**11, 1), (100, 10**9)], 8)
    assert time.perf_counter() - began < 1 and got[10**11] == [1] + [0] * 7
    assert sum(got[100]) == 10**9 and got[100][0] == 0 and max(got[100][1:]) - min(got[100][1:]) <= 1


def test_shards_of_long_texts_equal_a_plain_heap(spark):
    """Sizes near each other beyond 65,536 bytes, equal texts together."""
    rng = random.Random(8)
    texts = [f"{i:03d}" + "x" * n for i, n in enumerate([70_000 + rng.randint(0, 40) for _ in range(60)] + [rng.randint(0, 50) for _ in range(200)])]
    texts += texts[:5] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = Counter()
    for t in texts:
        weights[t or ""] += len(t or "") + 1
    want = Counter()
    for size, counts in plain_heap(list(weights.values()), 8).items():
        for k, n in enumerate(counts):
            want[k] += size * n
    got = rows(sharding.shard_by_size(df, 8))
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]] or "") + 1, zlib.crc32((texts[r["doc_id"]] or "").encode()))
    assert loads == want and len(got) == len(texts)


def test_sharding_is_balanced(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    loads = {r["shard"]: r["b"] for r in rows(sharding.shard_by_size(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")))}
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())


# --- op3 ---------------------------------------------------------------------------------------


def test_packing_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    sources = [rng.choice([-1, 0, 0, 0, 1, 2, 70]) for _ in sizes]
    clusters = [rng.choice([-1, -1, 0, 1, 2]) for _ in sizes]
    got, offsets = packing.pack_pieces(np.array(sizes), np.array(sources), np.array(clusters), 128)
    bins = []  # (room, sources, clusters), by brute force
    for n, s, c, b, at in zip(sizes, sources, clusters, got, offsets, strict=True):
        fit = [k for k, x in enumerate(bins) if x[0] >= n and not (s >= 0 and s in x[1]) and not (c >= 0 and c in x[2])]
        if fit:
            least = min(bins[k][0] for k in fit)
            assert bins[b][0] == least
        else:
            assert b == len(bins)
            bins.append([128, set(), set()])
        assert at == 128 - bins[b][0]
        bins[b][0] -= n
        bins[b][1].add(s), bins[b][2].add(c)


def test_packing_keeps_every_word(spark, odd):
    long = spark.createDataFrame([(50, "w " * 5000, None, "s1", None, None, None, None)], SCHEMA)
    docs = odd.unionByName(long)
    got = rows(packing.pack_documents(docs, 64, 4))
    assert sum(r["n"] for r in got if r["doc_id"] == 50) == 5000
    assert sum(r["n"] for r in got) == 5000 + sum(len((t or "").split()) for t in TEXTS) + 1 + 8
    assert all(r["bin"] is None for r in got if r["n"] == 0)
    held = {}
    for r in got:
        if r["bin"] is not None:
            held[r["bin"]] = held.get(r["bin"], 0) + r["n"]
    assert max(held.values()) <= 64


def test_packing_keeps_whole_number_ids_beside_a_null_id(spark):
    big = 2**53 + 1
    data = [(big, "a b c", "s0", 1), (big + 2, "d e", "s1", 2), (None, "f", "s2", 3), (big + 4, "", None, 4)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, task int")
    got = rows(packing.pack_documents(df))
    assert sorted((r["doc_id"] or 0, r["n"]) for r in got) == [(0, 1), (big, 3), (big + 2, 2), (big + 4, 0)]


def test_packing_query_columns_equal_brute_force_bins(spark):
    """One task: each bin as the tightest compatible one, recomputed from the texts with sets and dictionaries."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    texts += [t.upper() + " " for t in texts[:10]]
    data = [(i, t, f"s{rng.randint(0, 5)}" if i % 7 else None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["bin"], r["offset"]) for r in rows(packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string, source string"), 48, 1000))}
    want, bins = {}, []
    for i, t, source in sorted(data, key=lambda x: (-len(x[1].split()), x[0])):
        n, own = len(t.split()), " ".join(t.lower().split())
        fit = [b for b in bins if b["room"] >= n and source not in b["sources"] and own not in b["texts"]]
        best = min(fit, key=lambda b: (b["room"], b["aged"])) if fit else None
        if best is None:
            best = {"room": 48, "sources": set(), "texts": set(), "number": len(bins)}
            bins.append(best)
        want[i] = (best["number"], 48 - best["room"])
        best["room"] -= n
        best["aged"] = len(want)  # of bins with equal room, the one that came to it first is tried first
        best["sources"] |= {source} - {None}
        best["texts"].add(own)
    assert got == want


# --- op4 ---------------------------------------------------------------------------------------


def brute_scores(texts, order):
    import math

    docs = [(t or "").lower().split() for t in texts]

    def count(words, n):
        out = {}
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            out[g] = out.get(g, 0) + 1
        return out

    every = [{} for _ in range(order + 1)]
    for d in docs:
        for n in range(1, order + 1):
            for g, c in count(d, n).items():
                every[n][g] = every[n].get(g, 0) + c
    total = sum(map(len, docs))
    out = []
    for d in docs:
        own = [count(d, n) for n in range(order + 1)]
        rest = lambda g, own=own: every[len(g)].get(g, 0) - own[len(g)].get(g, 0)
        words = max(1, total - len(d))
        s = 0.0
        for i, w in enumerate(d):
            value = None
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                steps = min(order, i + 1) - n
                if rest(g) > 0:
                    value = 0.4**steps * (rest(g) / (words if n == 1 else rest(g[:-1])))
                    break
            if value is None:
                value = 0.4 ** (min(order, i + 1) - 1) * 0.4 / words
            s += math.log10(value)
        out.append(s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 200)
    monkeypatch.setattr(lm_score, "PART_ROWS", 40)
    monkeypatch.setattr(lm_score, "PACKED_ROWS", 25)
    rng = random.Random(order)
    texts = [" ".join(rng.choice("a b c d e f gg hh".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "one", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in rows(lm_score.score(df, order))}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts, order), abs=1e-9)


def test_score_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 30))) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in rows(lm_score.op4_lm_scores(spark, str(tmp_path)))}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts, 3), abs=1e-4)


def test_lm_stable_order_equals_numpys_stable_sort():
    rng = np.random.default_rng(4)
    for hashes in (
        rng.integers(0, 1 << 63, 5000, dtype=np.uint64)[rng.integers(0, 700, 20000)],
        np.array([7, 6, 7, 5, 6, 7], np.uint64),  # these differ in the bits that hold the places only
        np.zeros(9, np.uint64),
        np.empty(0, np.uint64),
    ):
        assert lm_score._stable_order(hashes).tolist() == np.argsort(hashes, kind="stable").tolist()


def test_count_tables(spark):
    df = spark.createDataFrame([("a b a b",), ("b",), (None,)], "text string")
    got = {(r["n"], r["gram"]): r["count"] for r in rows(lm_score.ngram_counts(df))}
    assert got == {(1, "a"): 2, (1, "b"): 3, (2, "a b"): 2, (2, "b a"): 1, (3, "a b a"): 1, (3, "b a b"): 1}


# --- op5 ---------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    v = [x.tolist() for x in rng.normal(size=(300, 5)) * rng.uniform(0.1, 3, (300, 1))]
    v[7] = v[100] = v[200] = v[0]  # ties
    v[13] = v[13][:3]  # a short vector
    data = list(enumerate(v)) + [(400, None), (500, [1.0, None]), (600, [float("nan")]), (None, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") % 10 == 0, 10, pivots=6))}
    m = np.zeros((300, 5), np.int64)
    for i, x in enumerate(v):
        m[i, : len(x)] = np.floor(1024 * np.array(x))
    want = {}
    for q in range(0, 300, 10):
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:10]
        want |= {(q, k + 1): (int(i), int(s[i])) for k, i in enumerate(order)}
    assert got == want


def test_top_k_prunes_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 4
    v = np.concatenate([c + rng.normal(size=(60, 8)) * 0.02 for c in centres])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert topk.searched_share(df, F.col("vec_id") % 20 == 0, 5, pivots=24) < 0.5
    m = np.floor(1024 * v).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") % 20 == 0, 5, pivots=24))}
    for q in range(0, len(v), 20):
        s = m @ m[q]
        order = [int(i) for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(s[i])) for i in order]


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") == 0))] == [(0, 1, 2 * 1024 * 1024)]
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_top_k_searches_a_repeated_query_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    v = [x.tolist() for x in rng.normal(size=(40, 4))]
    data = [(i, x, 7.0, i) for i, x in enumerate(v)] + [(0, v[0], None, None), (10, v[10], None, None), (10, [9.0, 9.0, 9.0, 9.0], 1.0, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double, rank int")
    got = rows(topk.top_k(df, F.col("vec_id") % 10 == 0, 5, pivots=4))
    whole = [(i, np.floor(1024 * np.array(x)).astype(np.int64)) for i, x, _, _ in data]
    want = []
    for q in range(0, 40, 10):
        own = min(x.tolist() for i, x in whole if i == q)
        found = sorted((-int(x @ np.array(own)), i) for i, x in whole if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


# --- op6 ---------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op6_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert n > 20 and right / n > 0.97


def test_language_edge_cases(spark, odd):
    profiles = language_id.profiles_of(odd)
    got = rows(language_id.predict(odd, profiles, "text", F.col("doc_id"), F.col("n_chars")))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] in (0, 1, 2, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.identified(odd, profiles).columns == odd.columns
    assert language_id.Profiles([]).predict("abc") == ("und", 0.0)


def test_gram_counts_equal_counting():
    text = "Éa aé, b9c  ab"
    grams, counts = language_id.gram_counts(text)
    marked = " éa aé b c ab "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " ") and not (n == 1 and g == " "):
                want[g] = want.get(g, 0) + 1
    assert sorted(counts.tolist()) == sorted(want.values()) and len(set(grams.tolist())) == len(want)


# --- op7 ---------------------------------------------------------------------------------------


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = rows(near_dedup.near_duplicates(odd, width=2))
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (0, 1, 2):
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (0, r["doc_id"], True)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert [r["component_id"] for r in got if r["doc_id"] == 3] == [3, 3]  # a repeated row
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_copies_without_id_take_the_least_id_or_none(spark):
    rows_, want = [], []
    for k in range(8):  # several groups: a wrong label would win in about half of them
        base = [f"w{k}x{i}" for i in range(40)]
        copy, third = " ".join([*base, "more"]), " ".join([*base, "other"])
        rows_ += [(None, copy, 3 * k), (10 * k + 5, " ".join(base), None), (10 * k + 6, third, None)]
        want += [(None, 10 * k + 5, False), (10 * k + 5, 10 * k + 5, True), (10 * k + 6, 10 * k + 5, False)]
        lone = [f"l{k}x{i}" for i in range(40)]
        rows_ += [(None, " ".join(lone), 100 + 3 * k), (None, " ".join([*lone, "more"]), 101 + 3 * k), (None, " ".join(lone), 102 + 3 * k)]
        want += [(None, None, True), (None, None, False), (None, None, False)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, row long")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in rows(near_dedup.near_duplicates(df, width=2))]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = [r for r in rows(near_dedup.near_duplicates(df, width=2, row_col="row")) if r["kept"] and r["doc_id"] is None]
    assert sorted(r["row"] // 3 for r in kept) == [(100 + 3 * k) // 3 for k in range(8)] and all(r["component_id"] is None for r in kept)


def test_full_set_sketches_never_reject_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 3, 50, 700, 5000):
        base = rng.integers(0, 2**64, n, np.uint64)
        for share in (0.8, 0.85, 0.9, 1.0):
            other = base.copy()
            kept = int(np.ceil(2 * n * share / (1 + share)))  # common shingles of two sets of n at this similarity
            other[kept:] = rng.integers(0, 2**64, n - kept, np.uint64)
            a, b = np.unique(base), np.unique(other)
            shared = len(np.intersect1d(a, b))
            linked = 100 * shared >= 80 * (len(a) + len(b) - shared)
            passed = near_dedup._differ_little(np.array([0]), np.array([1]), [near_dedup.parity(a), near_dedup.parity(b)], np.array([len(a), len(b)]), 0.8)
            assert passed[0] or not linked


# --- op8 ---------------------------------------------------------------------------------------


def test_cuckoo_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63, 20_000, np.int64)
    f = line_dedup.Cuckoo.sized(len(keys))
    assert f.insert(keys) and f.holds(keys).all()
    f.delete(keys[:10_000])
    assert f.holds(keys[10_000:]).all() and f.holds(keys[:10_000]).mean() < 0.01


def test_line_index_is_reversible(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(i, f"{line}\n own {i} text") for i in range(4)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs.where("doc_id < 2"))
    keys = index.refs.select("key").distinct()
    assert index.repeated(keys).count() == 0
    more = index.insert(docs.where("doc_id >= 2"))
    assert [r["n_docs"] for r in rows(more.repeated(more.refs.select("key").distinct()))] == [4]
    less = more.delete(docs.where("doc_id IN (1, 3)").select("doc_id"))
    assert less.repeated(keys).count() == 0
    again = less.insert(docs.where("doc_id = 1"))
    assert [r["last_doc"] for r in rows(again.repeated(keys))] == [2]


def test_full_filters_are_rebuilt_and_stay_reversible(spark):
    """Batches far larger than the filters they meet: no key is lost, inserting and deleting go on."""
    few = spark.createDataFrame([(i, "the first line that counts here") for i in range(3)], "doc_id long, text string")
    text = "\n".join(f"line number {k} that is long enough to count" for k in range(3000))
    many = spark.createDataFrame([(10 + i, text) for i in range(3)], "doc_id long, text string")
    more = line_dedup.LineIndex.build(few).insert(many)
    keys = more.refs.select("key").distinct()
    assert more.filters.where("filter IS NULL OR length(filter) = 0").isEmpty()
    assert more.repeated(keys).count() == 3001
    again = more.insert(spark.createDataFrame([(20 + i, text.replace("line", "other line")) for i in range(3)], "doc_id long, text string"))
    assert again.repeated(again.refs.select("key").distinct()).count() == 6001
    less = again.delete(many.select("doc_id").limit(1))
    assert less.repeated(keys).count() == 1


def test_lines_of_repeated_ids_and_clashing_columns(spark):
    a, b = "the first of two lines that repeat", "the second of two lines that repeat"
    data = [(1, a, 5, "x", None), (1, b, 6, "y", None), (2, f"{a}\n{b}", 7, "z", None), (3, f"{a.upper()}\n {b}\nown", 8, "w", None), (None, a, 9, "v", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_lines long, key string, gone string")
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["key"]) for r in rows(line_dedup.dedup_lines(df))]
    assert sorted(got, key=str) == sorted([(1, "", 1, 1, "x"), (1, "", 1, 1, "y"), (2, "", 2, 2, "z"), (3, f"{a.upper()}\n {b}\nown", 3, 0, "w"), (None, a, 1, 0, "v")], key=str)


def test_line_dedup_of_a_long_document_with_many_repeated_lines(spark):
    lines = [f"line number {k} that is long enough to count" for k in range(4000)]
    data = [(i, "\n".join(lines[i:] + [f"own {i}"])) for i in range(3)]
    got = {r["doc_id"]: r for r in rows(line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")))}
    assert [got[i]["n_dropped"] for i in range(3)] == [3998, 3998, 0]
    assert got[0]["text"] == "\n".join(lines[:2] + ["own 0"])


def test_line_dedup_edge_cases(spark, odd, empty):
    got = rows(line_dedup.dedup_lines(odd))
    assert len(got) == odd.count() and sum(r["n_dropped"] for r in got) == 0
    assert line_dedup.dedup_lines(empty).count() == 0


# --- op9 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 4095, 4096, 65_025, 255 * 255, 255 * 255 * 3 + 17])
def test_ogg_round_trip(n):
    text = random.Random(n).randbytes(n)
    payload = ogg.payload_of(text)
    assert len(payload) % 192 == 0 and payload.startswith(text)
    media = ogg.encode(payload)
    assert ogg.decode(media)["payload"] == payload


def test_ogg_checksum_is_the_published_one():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.page_checksum(data) == slow(data)


def test_ogg_lacing_of_packets_over_many_pages():
    packets = [(b"h" * 10, 0), (b"x" * 255, 255), (b"y" * 200_000, 200_255), (b"", 200_255), (b"z", 200_256)]
    media = b"".join(p for _, p in ogg.stream_pages(7, packets))
    s = ogg.logical_streams(media)[7]
    assert s["packets"] == [p for p, _ in packets]


def test_ogg_damage_is_found(spark):
    media = bytearray(ogg.encode(ogg.payload_of(b"some text" * 50)))
    media[len(media) // 2] ^= 1
    df = spark.createDataFrame([(1, 3, bytes(media)), (2, 3, None), (3, 3, b"junk")], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in rows(ogg.decode_media(df))}
    assert "checksum" in got[1]["error"] and got[2]["error"] == "no media" and got[3]["error"]


def test_ogg_malformed_streams_say_why(spark):
    """Valid checksums around packets that make no sense: every row gets its reason, none fails the job."""

    def one(*streams):
        return b"".join(p for k, packets in enumerate(streams) for _, p in ogg.stream_pages(k, packets))

    head, mark = ogg.PCM_HEAD.pack(ogg.PCM_MAGIC, 0, 0, 1, 8000, 0, 1, 4096, 0), ogg.MARK_HEAD.pack(ogg.MARK_MAGIC, 8000, 32000)
    stopped = ogg.PCM_HEAD.pack(ogg.PCM_MAGIC, 0, 0, 1, 0, 0, 1, 4096, 0)
    sound, marks = [(head, 0), (b"x" * 192, 192)], [(mark, 0), (b"0.000", 0)]
    empty_page = ogg._page(3, 0, ogg.FIRST | ogg.LAST, ogg.NO_PACKET_ENDS, b"", b"")
    media = {
        "good": one(sound, marks),
        "no packet": empty_page,
        "empty": b"",
        "short header": one([(b"PCM     ", 0), (b"x", 1)], marks),
        "short mark header": one(sound, [(b"TIMEMARK", 0)]),
        "rate 0": one([(stopped, 0), (b"x" * 192, 192)], marks),
        "no samples": one([(head, 0)], marks),
        "wrong granule": one([(head, 0), (b"x" * 192, 191)], marks),
        "granule without packet": ogg._page(3, 0, ogg.FIRST | ogg.LAST, 5, b"", b""),
        "wrong mark": one(sound, [(mark, 0), (b"1.000", 0)]),
        "mark not text": one(sound, [(mark, 0), (b"\xff\xfe", 0)]),
        "only sound": one(sound),
    }
    df = spark.createDataFrame([(i, 192, m) for i, m in enumerate(media.values())], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in rows(ogg.decode_media(df))}
    assert len(got) == len(media)
    for i, name in enumerate(media):
        assert (got[i]["error"] is None) == (name == "good"), name
        assert (got[i]["feature"] is None) == (name != "good")
    assert {r["doc_id"] for r in rows(ogg.packet_times(df))} == {0}


def test_packets_are_timed_by_granules(spark):
    n = 3 * 32_000 + 5
    got = rows(ogg.packet_times(ogg.encode_media(spark.createDataFrame([(1, "a" * n)], "doc_id long, text string"))))
    total = -(-n // 192) * 192
    sound = sorted((r["packet"], r["start_s"], r["end_s"], r["n_bytes"]) for r in got if r["stream"] == "PCM")
    assert sound == [(k + 1, a / 8000, min(a + 4096, total) / 8000, min(4096, total - a)) for k, a in enumerate(range(0, total, 4096))]
    assert sorted((r["packet"], r["start_s"]) for r in got if r["stream"] == "TIMEMARK") == [(k + 1, 4.0 * k) for k in range(4)]


def test_ogg_query_fields_are_recomputed(spark, sf):
    """All contract columns from the texts and, for the stored form, from the media column by itself."""
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))}
    media = {r["doc_id"]: bytes(r["media"]) for r in rows(ogg.encode_media(spark.read.parquet(f"{sf}/documents.parquet")))}
    got = rows(ogg.op9_ogg_media(spark, sf))
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[r["doc_id"]]), hashlib.sha256(media[r["doc_id"]]).hexdigest())
        x = np.frombuffer(payload, np.uint8)
        fields = dict(f.split("=") for f in r["feature"].split(";"))
        assert float(fields["seconds"]) == pytest.approx(len(payload) / 8000, abs=1e-6) and float(fields["mean"]) == pytest.approx(x.mean(), abs=1e-6)
        assert int(fields["crossings"]) == sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:], strict=False))
        assert int(fields["packets"]) == 1 + -(-len(payload) // 4096) and int(fields["marks"]) == -(-len(payload) // 32_000)


def test_ogg_edge_cases(spark, odd):
    got = rows(ogg.decode_media(ogg.encode_media(odd)))
    assert len(got) == odd.count() and all(r["error"] is None for r in got)
    blank = hashlib.sha256(b" " * 192).hexdigest()
    assert {r["payload_sha256"] for r in got if r["n_bytes"] == 0} == {blank}


# --- op10 --------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    own = bpe.Encoder(open(bpe.VOCABULARY).read())
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["<|endoftext|>", "a<|endoftext|> b", "\0special<|endoftext|>", "don't WE'LL   x \n\n y", "a" * 3000]
    texts += ["".join(rng.choice("ab cé中　 '\n\U0001f6000") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == t


def test_bpe_digests_equal_the_library_on_a_table(spark, sf, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        texts = Counter((r["doc_id"], r["text"] or "") for r in rows(df))
        want = Counter()
        for (i, t), n in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += n
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.digests(df))) == want


def test_bpe_refuses_files_that_ask_for_more():
    spec = json.loads(open(bpe.VOCABULARY).read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError, match="tokenizer file"):
            bpe.refuse_unsupported(spec | change)


def test_bpe_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    own = bpe.Encoder(open(bpe.VOCABULARY).read())
    fresh = bpe.Encoder(open(bpe.VOCABULARY).read())
    for k in range(50):
        text = f"piece{k} " + "z" * (100 + k)
        assert own.encode_batch([text]) == fresh.encode_batch([text])
        assert len(own.known) + len(own.older) < 200


def test_bpe_round_trip(spark, odd):
    ids = bpe.encode(odd)
    back = {r["doc_id"]: r["text"] for r in rows(bpe.decode(ids)) if r["doc_id"] is not None}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    got = {r["doc_id"]: r for r in rows(bpe.digests(odd))}
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


# --- all ---------------------------------------------------------------------------------------


def test_operators_take_empty_tables(spark, empty):
    assert sharding.shard_by_size(empty, 8).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert lm_score.score(empty).count() == 0
    assert ogg.decode_media(ogg.encode_media(empty)).count() == 0
    assert bpe.digests(empty).count() == 0
    assert language_id.predict(empty, language_id.profiles_of(empty), "text", F.col("doc_id")).count() == 0


def test_scores_of_odd_rows(spark, odd):
    got = rows(lm_score.score(odd))
    assert len(got) == odd.count()
    assert all((r["mean_score"] is None) == (r["n_words"] == 0) for r in got)


def test_every_operator_has_its_query():
    names = sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES)
    assert names == list(range(1, 14))


def test_scratch_tables_can_be_removed(spark):
    df = common.written(spark.range(5), "probe")
    assert df.count() == 5
    common.clear_scratch(spark)
    with pytest.raises(Exception, match="exist|find|found"):
        spark.read.parquet(df._scratch).count()


def test_written_tables_leave_no_shuffle_files(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}

    before, setting = held(), spark.conf.get(tables.SWEEP, None)
    df = spark.range(20_000).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("h")).repartition(3, "h")
    made = [common.written(df, "swept"), common.bucketed(df, "swept", "k", 3), tables.stored(df)]
    for _ in range(50):  # they are removed in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(tables.SWEEP, None) == setting
    assert [t.count() for t in made] == [20_000] * 3
    common.discard(*made[:2])
    tables.forget(made[2])
