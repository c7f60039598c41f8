"""Byte-level BPE encoding and decoding through segment trees over adjacent pair ranks.

Each piece of a text (the published split pattern) is a row of symbols.  A segment
tree holds the rank of every adjacent pair; its root is the leftmost lowest rank.
That pair merges, the two neighbouring pairs are updated in logarithmic time, and
this repeats until the root says that no pair merges.  Short pieces of a batch go
through their trees together, one numpy step per level; long ones use a tree of
their own.

Defined cases: null text is empty text, which has no tokens; special tokens of the
vocabulary file found in a text are single ids, as the file demands.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces of up to so many bytes go through their trees together.
TOGETHER = 64
#: Bytes of pieces in a task's newer memory, and what a piece weighs at least; a full one becomes the older.
#: Bounds a worker's memory, not what is encoded.
REMEMBERED, LEAST_WEIGHT = 9_600_000, 64
NEVER = np.int64(1) << np.int64(40)
# The published split pattern of byte-level BPE vocabularies; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def refuse_unsupported(spec: dict) -> None:
    """Raise where a tokenizer file asks for what this module does not do, rather than encode otherwise than it says."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in (
            ("a model other than BPE", model.get("type", "BPE") != "BPE"),
            ("dropout", model.get("dropout")),
            ("subword affixes", model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
            ("byte fallback", model.get("byte_fallback")),
            ("merges ignored for whole words", model.get("ignore_merges")),
            ("a normalizer", spec.get("normalizer")),
            ("a pre-tokenizer other than byte-level", pre.get("type") != "ByteLevel"),
            ("a prefix space", pre.get("add_prefix_space")),
            ("a split other than the byte-level pattern", pre.get("use_regex") is False),
            ("added tokens that strip blanks or match whole words only", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"the tokenizer file has {', '.join(wrong)}")


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file, as arrays for lookups of many pairs."""

    def __init__(self, source: str):
        spec = json.loads(source)
        refuse_unsupported(spec)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        self.bytes_of = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for word, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << np.int64(20) | right
        self.made = made  # by rank
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self._fill(keys)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B97F4A7C1 | 1) >> np.int64(40)) & np.int64(len(self.keys) - 1)

    def _fill(self, keys: np.ndarray) -> None:
        """A hash table with open addressing, filled in rounds: whoever finds a slot free takes it."""
        self.keys = np.full(1 << max(4, (4 * len(keys)).bit_length()), -1, np.int64)
        self.ranks = np.full(len(self.keys), NEVER, np.int64)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        self.steps = 0
        while len(rest):
            free = self.keys[slot[rest]] < 0
            self.keys[slot[rest[free]]] = keys[rest[free]]
            placed = self.keys[slot[rest]] == keys[rest]
            self.ranks[slot[rest[placed]]] = rest[placed]
            rest = rest[~placed]
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            self.steps += 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of many pairs; NEVER where a pair has none or a side is missing (-1)."""
        key = left << np.int64(20) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NEVER)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[rest]]
            out[rest] = np.where(found == key[rest], self.ranks[slot[rest]], NEVER)
            rest = rest[(found != key[rest]) & (found >= 0)]
        out[(left < 0) | (right < 0)] = NEVER
        return out


def merge_together(v: Vocabulary, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
    """Encode pieces of at most ``width`` bytes (a power of two): one segment tree per row.

    tree[:, 1] is a row's root and tree[:, width + p] the leaf of the pair that starts at p. A node holds
    rank * width + position, so the least value is the leftmost lowest rank.
    """
    n, never = len(pieces), NEVER * width
    size = np.fromiter(map(len, pieces), np.int64, n)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum(size) - size
    stride = width + 1  # a spare last place, always empty
    at = np.arange(len(flat)) + np.repeat(np.arange(n) * stride - first, size)
    ids = np.full(n * stride, -1, np.int64)
    ids[at] = v.byte_ids[flat]
    place = np.tile(np.arange(stride), n)
    after, before = place + 1, place - 1
    tree = np.full(n * 2 * width, never, np.int64)
    at = at[ids[at + 1] >= 0]  # both sides of a pair are there
    row = at // stride
    tree[row * 2 * width + width + at - row * stride] = v.pair_ranks(ids[at], ids[at + 1]) * width + at - row * stride
    nodes, level = tree.reshape(n, 2 * width), width
    while level > 1:
        nodes[:, level // 2 : level] = np.minimum(nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(root: np.ndarray, position: np.ndarray, rank: np.ndarray | np.int64) -> None:
        """Set leaves and climb to the roots; root: where each row's tree begins."""
        node = position + width
        tree[root + node] = rank * width + position
        for _ in range(width.bit_length() - 1):
            pair = root + (node & ~1)
            node = node >> 1
            tree[root + node] = np.minimum(tree.take(pair), tree.take(pair + 1))

    rows = np.flatnonzero(nodes[:, 1] < never)
    while len(rows):
        root, base = rows * (2 * width), rows * stride
        rank, at = np.divmod(tree.take(root + 1), width)
        here = base + at
        right = after.take(here)
        beyond = after.take(base + right)
        made = v.made.take(rank)
        ids[here] = made
        ids[base + right] = -1
        after[here] = beyond
        beyond = np.minimum(beyond, width)
        before[base + beyond] = at
        update(root, right, NEVER)
        update(root, at, v.pair_ranks(made, ids.take(base + beyond)))
        ahead = before.take(here)
        has = np.flatnonzero(ahead >= 0)
        if len(has):
            r, p = root.take(has), ahead.take(has)
            update(r, p, v.pair_ranks(ids.take(base.take(has) + p), made.take(has)))
        rows = rows[tree.take(root + 1) < never]
    kept = (ids >= 0).reshape(n, stride)
    values = ids[ids >= 0].tolist()
    ends = np.cumsum(kept.sum(axis=1)).tolist()
    return [tuple(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def merge_alone(v: Vocabulary, piece: bytes) -> tuple[int, ...]:
    """Encode one long piece with its own segment tree."""
    ids = v.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n, width, never, ranks, made = len(ids), 1, int(NEVER), v.rank_of, v.made.tolist()
    while width < n:
        width *= 2
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [never * width] * (2 * width)
    for p in range(n - 1):
        tree[width + p] = ranks.get(ids[p] << 20 | ids[p + 1], never) * width + p
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, rank: int) -> None:
        node = at + width
        tree[node] = rank * width + at
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while tree[1] < never:
        rank, at = divmod(tree[1], width)
        right = after[at]
        beyond = after[right]
        ids[at], ids[right] = made[rank], -1
        after[at] = beyond
        update(right, never)
        if beyond < n:
            before[beyond] = at
        update(at, ranks.get(ids[at] << 20 | ids[beyond], never) if beyond < n else never)
        if before[at] >= 0:
            update(before[at], ranks.get(ids[before[at]] << 20 | ids[at], never))
    return tuple(i for i in ids if i >= 0)


class Encoder:
    """Encodes texts, remembering of the pieces that it has met their ids, these in decimal, and their bytes decoded."""

    def __init__(self, source: str):
        self.v = Vocabulary(source)
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.weight = 0

    def pieces(self, text: str) -> list[str]:
        v = self.v
        if v.cut is None or not any(s in text for s in v.special):
            return v.pattern.findall(text)
        out: list[str] = []
        for k, part in enumerate(v.cut.split(text)):
            out += [f"\0special{part}"] if k % 2 else v.pattern.findall(part)
        return out

    def learn(self, new: list[str]) -> None:
        older = self.older
        again = [s for s in new if s in older]
        self.known.update((s, older[s]) for s in again)
        self.weight += sum(max(LEAST_WEIGHT, len(s)) for s in again)
        for s in [s for s in new if s.startswith("\0special") and s[8:] in self.v.special]:
            self.remember([s], [(self.v.special[s[8:]],)])
        by_width: dict[int, list[str]] = {}
        for s in new:
            if s not in self.known:
                n = len(b := s.encode())
                by_width.setdefault(0 if n > TOGETHER else max(2, 1 << (n - 1).bit_length()), ([], []))
                group = by_width[0 if n > TOGETHER else max(2, 1 << (n - 1).bit_length())]
                group[0].append(s)
                group[1].append(b)
        for width, (names, group) in by_width.items():
            if not width:
                self.remember(names, [merge_alone(self.v, b) for b in group])
                continue
            for a in range(0, len(group), 8192):
                self.remember(names[a : a + 8192], merge_together(self.v, group[a : a + 8192], width))

    def remember(self, pieces: list[str], encoded: list[tuple[int, ...]]) -> None:
        decimal, bytes_of = self.v.decimal.__getitem__, self.v.bytes_of.__getitem__
        for s, ids in zip(pieces, encoded, strict=True):
            self.known[s] = (ids, ",".join(map(decimal, ids)), b"".join(map(bytes_of, ids)))
        self.weight += sum(max(LEAST_WEIGHT, len(s)) for s in pieces)

    def lookup(self, texts: list[str | None]) -> list[list[tuple[tuple[int, ...], str, bytes]]]:
        """What is known of the pieces of each text, after learning the new ones."""
        if self.weight > REMEMBERED:
            self.known, self.older, self.weight = {}, self.known, 0
        split = [self.pieces(t or "") for t in texts]
        self.learn(list(set(chain.from_iterable(split)) - self.known.keys()))
        return [list(map(self.known.__getitem__, p)) for p in split]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(e[0] for e in entries)) for entries in self.lookup(texts)]

    def decode(self, ids: list[int]) -> str:
        """Bytes of the ids, special tokens included; ill-formed parts become U+FFFD."""
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _each(source: str, batches: Iterator[pa.RecordBatch], batch_rows: int = 64):
    encoder = Encoder(source)
    gc.disable()  # no cycles are made here, and millions of remembered tuples make collections slow
    for batch in batches:
        for at in range(0, batch.num_rows, batch_rows):
            part = batch.slice(at, batch_rows)
            yield part, encoder.lookup(part.column(1).to_pylist())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ``ids``, the whole text's token ids. Map-only."""
    source = Path(vocabulary).read_text()

    def run(batches):
        for part, texts in _each(source, batches):
            ids = [list(chain.from_iterable(e[0] for e in entries)) for entries in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give null."""
    source = Path(vocabulary).read_text()

    def run(batches):
        encoder = Encoder(source)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, in one pass over the texts."""
    source = Path(vocabulary).read_text()

    def one(entries: list[tuple[tuple[int, ...], str, bytes]]) -> tuple[int, str, str]:
        ids, decimal, decoded = zip(*entries, strict=True) if entries else ((), (), ())
        text = b"".join(decoded).decode("utf-8", "replace")
        return sum(map(len, ids)), hashlib.sha256(",".join(decimal).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        for part, texts in _each(source, batches):
            rows = list(zip(*map(one, texts), strict=True))
            columns = [part.column(0), *(pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
