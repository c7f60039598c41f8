"""Token counts of byte-level BPE by heap and linked list, without emitting any ids.

The pieces of a text (the published split pattern) are linked lists of symbols, one a
byte at first.  A heap holds the rank and place of every adjacent pair that merges; the
lowest rank, leftmost first, is popped, its right symbol leaves the list, and the two
new pairs enter the heap.  An entry whose pair has changed since is passed over.  The
count is the number of bytes less the number of merges, so symbols are kept as far as
ranks need them and no sequence of tokens is built.

Defined cases: null text is empty text, which has no tokens; special tokens of the
vocabulary file found in a text are one token each, as the file demands; rows with
repeated or null ids are counted row by row; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.bpe import VOCABULARY, Vocabulary
from sparksci.llm.common import byte_length, table

LIMIT = 1024
#: Characters of pieces in a task's newer memory (each weighs LEAST_WEIGHT at least); a full one becomes the older.
#: Bounds a worker's memory, not what is counted.
REMEMBERED, LEAST_WEIGHT = 12_000_000, 64
#: Bits of a symbol's place in a heap entry.
PLACE = 40
#: Rows that are split and counted together.
BATCH_ROWS = 64


class Counter:
    """Counts tokens of texts, remembering the counts of the pieces that it has met."""

    def __init__(self, source: str):
        self.v = Vocabulary(source)
        self.byte_ids = self.v.byte_ids.tolist()
        self.made = self.v.made.tolist()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.weight = 0

    def merges(self, piece: bytes) -> int:
        """How many merges the piece takes. A heap entry is rank << PLACE | place, so the least is the leftmost lowest rank."""
        rank_of, made = self.v.rank_of.get, self.made
        symbols = [self.byte_ids[b] for b in piece]
        n = len(symbols)
        heap = []
        left = symbols[0] if n else 0
        for at in range(1, n):
            right = symbols[at]
            rank = rank_of(left << 20 | right)
            if rank is not None:
                heap.append(rank << PLACE | at - 1)
            left = right
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            entry = heappop(heap)
            rank, at = entry >> PLACE, entry & (1 << PLACE) - 1
            right = after[at]
            # Symbols that left the list are -1, which no pair with a rank has.
            if right == n or symbols[at] < 0 or rank_of(symbols[at] << 20 | symbols[right]) != rank:
                continue
            done += 1
            beyond = after[right]
            symbols[at], symbols[right], after[at] = made[rank], -1, beyond
            if beyond < n:
                before[beyond] = at
                new = rank_of(made[rank] << 20 | symbols[beyond])
                if new is not None:
                    heappush(heap, new << PLACE | at)
            ahead = before[at]
            if ahead >= 0:
                new = rank_of(symbols[ahead] << 20 | made[rank])
                if new is not None:
                    heappush(heap, new << PLACE | ahead)
        return done

    def learn(self, pieces: set[str]) -> None:
        for piece in pieces:
            count = self.older.get(piece)
            if count is None:
                raw = piece.encode()
                count = len(raw) - self.merges(raw)
            self.known[piece] = count
            self.weight += max(LEAST_WEIGHT, len(piece))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.weight > REMEMBERED:
            self.known, self.older, self.weight = {}, self.known, 0
        v, split, special = self.v, [], []
        for text in texts:
            if v.cut is not None and any(s in text for s in v.special):
                parts = v.cut.split(text)  # every second part is a special token
                split.append([p for part in parts[::2] for p in v.pattern.findall(part)])
                special.append(len(parts) // 2)
            else:
                split.append(v.pattern.findall(text))
                special.append(0)
        self.learn(set().union(*split).difference(self.known))
        return [sum(map(self.known.__getitem__, pieces)) + more for pieces, more in zip(split, special, strict=True)]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of every row. Map-only."""
    source = Path(vocabulary).read_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(source)
        gc.disable()  # no cycles are made here, and many remembered pieces make collections slow
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                counts = counter.count([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), byte_length(F.col(text_col)).alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents"))
