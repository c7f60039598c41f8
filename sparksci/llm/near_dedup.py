"""Near-duplicate detection: banded MinHash, odd sketches as a filter, links confirmed on full sets.

Every document's set of word shingles gives MinHash samples.  Bands of samples put
likely pairs into buckets; the samples, folded into a parity bitmap (an odd sketch),
travel with each document, and the population count of two sketches' XOR estimates
the similarity, so that pairs far below the threshold are never fetched.  What is
left is confirmed on the full sets.  Documents with equal sets are one node from the
start.  Round 1 deals each bucket to chunks of a bounded size, a row a member, and
confirms each document's best partner there and its likeness to the bucket's first
member; round 2 confirms every pair that passes and still lies in two components, so
large groups of copies cost a few links a document and no link between different texts
is lost.  Round 2 also folds the
full sets into odd sketches that grow with them: their XOR has at most as many bits as
the sets differ in shingles, so a pair with more is certainly below the threshold.

The bands miss a pair at the threshold with a probability of (1 - 0.8**4)**24 = 3e-6.

Defined cases: documents without words are linked with nothing; fewer words than a
shingle are one shingle; rows without id are linked like others. A component's id is
its least id, and null if nobody in it has one; then one of its rows is kept. Repeated
rows share a component, and all rows that hold its id are kept; where a column tells
rows apart, one of them is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import discard, mix64, sequence_hashes, table, word_hashes, written

SAMPLES = 128
BANDS, ROWS = 24, 4
SKETCH_BITS = 256
#: Standard deviations of the sketch's estimate that a pair at the threshold may lie below it.
MARGIN = 5
#: Members of a bucket compared in one group of rows; larger buckets are split into chunks.
CHUNK = 256

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 2**64, SAMPLES, np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, SAMPLES, np.uint64)
_SEEDS = mix64(np.arange(SAMPLES, dtype=np.uint64))


def most_bits_apart(similarity: float) -> int:
    """Bits of XOR up to which two sketches may belong to a pair at the threshold."""
    n, k = SKETCH_BITS, SAMPLES
    apart = 2 * k * (1 - similarity)
    mean = n * (1 - (1 - 2 / n) ** apart) / 2
    from_samples = (1 - 2 / n) ** apart * 2 * math.sqrt(k * similarity * (1 - similarity))
    from_folding = math.sqrt(n * (1 - (1 - 2 / n) ** (2 * apart)) / 4)
    return math.ceil(mean + MARGIN * math.hypot(from_samples, from_folding))


def shingle_set(tokens: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles in order; a shorter text is one shingle."""
    return np.unique(sequence_hashes(tokens, min(width, len(tokens)))) if len(tokens) else np.empty(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(out, (part[:, None] * _FACTORS + _SHIFTS).min(axis=0), out=out)
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[r : BANDS * ROWS : ROWS])
    return h


def odd_sketch(s: np.ndarray) -> bytes:
    at = (mix64(s + _SEEDS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def parity(shingles: np.ndarray) -> bytes:
    """The odd sketch of a full set, of two to four bits a shingle (a power of two, 1,024 at least)."""
    bits = max(1024, 1 << (2 * len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(column: list[bytes], width: int) -> np.ndarray:
    """Full-set sketches of ``width`` bytes or twice that, as rows of ``width``: a long one is the XOR of its halves."""
    rows = [np.frombuffer(b, np.uint64) for b in column]
    return np.stack([r if len(r) * 8 == width else r[: width // 8] ^ r[width // 8 :] for r in rows])


def _differ_little(i: np.ndarray, j: np.ndarray, full: list[bytes], size: np.ndarray, similarity: float) -> np.ndarray:
    """False where the full-set sketches prove that pair (i, j) is below the threshold."""
    percent = round(similarity * 100)
    width = np.array([len(b) for b in full])
    least, out = np.minimum(width[i], width[j]), np.ones(len(i), bool)
    for w in np.unique(least).tolist():
        own = np.flatnonzero((least == w) & (np.maximum(width[i], width[j]) <= 2 * w))
        used, at = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
        rows = _folded([full[k] for k in used.tolist()], w)
        for a in range(0, len(own), 4096):
            some = own[a : a + 4096]
            x, y = at[: len(own)][a : a + 4096], at[len(own) :][a : a + 4096]
            apart = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64)
            out[some] = apart * (100 + percent) <= (size[i[some]] + size[j[some]]) * (100 - percent)
    return out


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    ends, flat = column.offsets.to_numpy().tolist(), column.values.to_numpy().view(np.uint64)
    for a, b in zip(ends, ends[1:], strict=False):
        yield flat[a:b]


def features(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n (shingles), set (its fingerprint), bands, both sketches and row (of row_col; else a number if there is no id) of every row. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, bands, sketches, full = [], [], [], [], []
            for tokens in _tokens(batch.column(1)):
                x = shingle_set(tokens, width)
                n.append(len(x))
                if not len(x):
                    sets.append(None), bands.append(None), sketches.append(None), full.append(None)
                    continue
                s = samples(x)
                sets.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                bands.append(band_keys(s).view(np.int64))
                sketches.append(odd_sketch(s))
                full.append(parity(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(full, pa.binary()), batch.column(2)],
                names=["doc_id", "n", "set", "bands", "sketch", "full", "row"],
            )

    doc_id = F.col(id_col).cast("long")
    row = F.col(row_col).cast("long") if row_col else F.when(doc_id.isNull(), F.monotonically_increasing_id())
    rows = df.select(doc_id.alias("doc_id"), word_hashes(F.col(text_col)).alias("tokens"), row.alias("row"))
    return rows.mapInArrow(run, "doc_id long, n long, set binary, bands array<long>, sketch binary, full binary, row long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows, sorted by (key, lo, hi), and where each begins."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        key, lo, hi = (t.column(c).to_numpy() for c in range(3))
        new = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        starts = np.r_[0, np.flatnonzero(new) + 1] if len(key) else np.zeros(1, np.int64)
        whole = int(starts[-1])
        if whole:
            yield t.slice(0, whole), starts
        rest = t.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _pairs(every: bool, most_apart: int, ratio: float):
    """Candidate pairs of each group of rows (key, lo, hi). every: all that pass; else each member's best partner and those with the first member.

    A group is either one chunk (lo = hi), compared with itself, or two chunks, compared with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches):
            sets = t.column(4).combine_chunks()
            size, part, label = (t.column(c).to_numpy() for c in (5, 3, 7))
            bits = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
            full = t.column(8).to_pylist() if every else []
            left, right = [], []
            lengths = np.diff(starts)
            two = starts[:-1][lengths == 2]
            if len(two):
                a, b = two, two + 1
                fit = (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= most_apart) & (label[a] != label[b])
                fit &= (np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b])) & ((part[a] != part[b]) | (t.column(1).to_numpy()[a] == t.column(2).to_numpy()[a]))
                left.append(a[fit]), right.append(b[fit])
            for a, m in zip(starts[:-1][lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                own = slice(a, a + m)
                inside = t.column(1)[a].as_py() == t.column(2)[a].as_py()
                for at in range(a, a + m, 128):
                    some = slice(at, min(a + m, at + 128))
                    apart = np.bitwise_count(bits[some, None] ^ bits[None, own]).sum(axis=2, dtype=np.int32)
                    fit = (apart <= most_apart) & (label[some, None] != label[None, own])
                    fit &= np.minimum(size[some, None], size[None, own]) >= ratio * np.maximum(size[some, None], size[None, own])
                    if not inside:
                        fit &= part[some, None] != part[None, own]
                    if every:
                        i, j = np.nonzero(fit)
                        i, j = i + at, j + a
                        i, j = i[i < j], j[i < j]
                        near = _differ_little(i, j, full, size, ratio)
                        left.append(i[near]), right.append(j[near])
                    else:
                        best = np.where(fit, apart, 1 << 20).argmin(axis=1)
                        i = np.arange(len(best))
                        has = fit[i, best]
                        left.append(i[has] + at), right.append(best[has] + a)
                        first = np.flatnonzero(fit[:, 0])
                        left.append(first + at), right.append(np.full(len(first), a))
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([sets.take(pa.array(i)), sets.take(pa.array(j))], names=["a", "b"])

    return run


def candidates(groups: DataFrame, every: bool, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of set fingerprints from (key, lo, hi, part, set, n, sketch, label), and full if all pairs are asked for."""
    rows = groups.select("key", "lo", "hi", "part", "set", "n", "sketch", "label", *(["full"] if every else []))
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "label", "set")
    pairs = dealt.mapInArrow(_pairs(every, most_bits_apart(similarity), similarity), "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bucketed(sets: DataFrame) -> DataFrame:
    """(key, m, set, n, sketch, label): the members of the buckets that hold two sets or more, a row each."""
    rows = sets.select("set", "n", "sketch", "label", F.explode("bands").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("first")).where("m > 1")
    return rows.join(held, "key").select("key", "m", "first", "set", "n", "sketch", "label")


def starred(buckets: DataFrame) -> DataFrame:
    """Groups of a bounded size for round 1: each member in one chunk of its bucket, and the bucket's first member in every chunk."""
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("set"), chunks).cast("int")
    to = F.when(F.col("label") == F.col("first"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    # The first member has the least label of its bucket, so it leads every chunk.
    return buckets.select("key", F.explode(to).alias("lo"), "set", "n", "sketch", "label").select("key", "lo", F.col("lo").alias("hi"), F.col("lo").alias("part"), "set", "n", "sketch", "label")


def still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups for round 2: the buckets whose members still lie in two components, as chunks that must meet.

    Members of the component with most of the bucket are not compared with each other again: their chunks meet
    those of the others only, so a bucket of m members of which r lie outside gives m + r * (m / CHUNK) rows, not m * m / CHUNK.
    """
    now = buckets.select("key", "set", "n", "sketch", F.col("label").alias("node")).join(labels, "set", "left").withColumn("label", F.coalesce("label", "node"))
    parts = now.groupBy("key", "label").agg(F.count("*").alias("c"))
    shape = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("m"), F.count("*").alias("components"))
    # A bucket of two was compared in full in round 1.
    shape = shape.where("m > 2 AND components > 1").select("key", F.col("most.label").alias("main"), F.ceil(F.col("most.c") / CHUNK).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("most.c")) / CHUNK).cast("int").alias("others"))
    member = now.join(shape, "key")
    in_main = F.col("label") == F.col("main")
    chunks = F.when(in_main, F.col("mains")).otherwise(F.col("others"))
    # Chunks of the others are numbered first, those of the main component after them.
    part = F.pmod(F.xxhash64("set"), chunks).cast("int") + F.when(in_main, F.col("others")).otherwise(F.lit(0))
    meets = F.sequence(F.lit(0), F.col("others") - 1 + F.when(in_main, F.lit(0)).otherwise(F.col("mains")))
    rows = member.select("key", part.alias("part"), F.explode(meets).alias("other"), "set", "n", "sketch", "label")
    return rows.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "set", "n", "sketch", "label")


def full_sets(df: DataFrame, chosen: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(set, shingles) of the chosen (set, rep), computed once more from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [shingle_set(t, width) for t in _tokens(part.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in x], pa.binary()), pa.array([s.tobytes() for s in x], pa.binary())], names=["set", "shingles"]
                )

    ids = chosen.select(F.col("rep").alias("__rep")).distinct()
    texts = df.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("__rep")), "left_semi").select(word_hashes(F.col(text_col)).alias("tokens"))
    made = texts.mapInArrow(run, "set binary, shingles binary")
    return made.join(chosen.select("set"), "set", "left_semi").dropDuplicates(["set"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked; whole numbers decide."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(set, label): the least node reachable, for every (set, node) that has a link.

    Labels go along links and then jump to the label of the node that they name; each pass is written, so
    lineage stays short. Passes grow with the logarithm of a component's diameter.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "near-links")
    labels = written(nodes.join(both.select(F.col("a").alias("set")).distinct(), "set", "left_semi").select("set", "node", F.col("node").alias("label")), "near-labels")
    while True:
        around = both.join(labels.select(F.col("set").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        nearer = labels.join(around, labels["set"] == around["a"], "left").select("set", "node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        named = labels.groupBy(F.col("node").alias("name")).agg(F.min("label").alias("goal"))
        jumped = written(
            nearer.join(named, nearer["label"] == named["name"], "left").select("set", "node", F.least("label", "goal").alias("label"), (F.least("label", "goal") != F.col("was")).alias("moved")),
            "near-labels",
        )
        moved = not jumped.where("moved").isEmpty()
        discard(labels)
        labels = jumped
        if not moved:
            discard(both)
            return labels.select("set", "label")


def near_duplicates(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of df; and row_col, if named.

    row_col holds numbers that tell rows without id, or with a repeated id, apart, and null elsewhere.
    """
    rows = written(features(df, width, id_col, text_col, row_col), "near-rows")
    # Of rows with one set, and later of a component, the head is the row with the least id, any id before none.
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("head")
    sets = rows.where("n > 0").groupBy("set").agg(head, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("full").alias("full"))
    # Sets are numbered: ids name components at the end only, as rows can lack them.
    sets = written(sets.withColumn("label", F.monotonically_increasing_id()), "near-sets")
    buckets = written(bucketed(sets), "near-buckets")

    def asked(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
        new = nodes if known is None else nodes.join(known.select("set"), "set", "left_anti")
        return sets.join(new, "set", "left_semi").select("set", F.col("head.doc_id").alias("rep"))

    first = written(candidates(starred(buckets), False, similarity), "near-pairs")
    full = written(full_sets(df, asked(first), width, id_col, text_col), "near-full")
    links = written(confirmed(first, full, similarity), "near-links")
    numbered = sets.select("set", F.col("label").alias("node"))
    labels = components(numbered, links)
    # Round 2: all pairs that pass and lie in two components.
    open_groups = still_open(buckets, labels).join(sets.select("set", "full"), "set")
    second = written(candidates(open_groups, True, similarity).join(first, ["a", "b"], "left_anti"), "near-pairs")
    if not second.isEmpty():
        more = written(asked(second, full), "near-asked")  # sets whose partners were all in other chunks
        every = full if more.isEmpty() else full.union(written(full_sets(df, more, width, id_col, text_col), "near-full"))
        new = written(confirmed(second, every, similarity), "near-links")
        if not new.isEmpty():
            labels = components(numbered, links.union(new))
    discard(buckets, first, second, full, links)
    heads = sets.select("set", "head").join(labels, "set").groupBy("label").agg(F.min("head").alias("head"))
    linked = labels.join(heads, "label").select("set", F.col("head").alias("linked"))
    known = sets.select("set", "head").join(linked, "set", "left").select("set", F.coalesce("linked", "head").alias("head"))
    out = rows.select("doc_id", "n", "set", "row").join(known, "set", "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    kept = F.col("head").isNull() | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("row").eqNullSafe(F.col("head.row")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *([F.col("row").alias(row_col)] if row_col else []))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at a similarity of 0.8 on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words
), sized AS (
  SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared WHERE 100 * i >= 80 * (nx + ny - i)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
), least_ids AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(l.y, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ids l ON l.x = d.doc_id
"""
