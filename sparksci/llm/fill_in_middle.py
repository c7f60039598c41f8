"""Fill-in-middle transformation by an event scan.

One Aho-Corasick automaton over a text finds the ASCII characters at which the class of
characters may change (blanks, or line ends) and the sentinels.  Between two events the
text is of one class, so the units of a gap are counted by arithmetic: as many as it has
code points where a unit is a code point, one where a unit is a run.  The events with
their running counts are the whole rank table: the offset of the k-th unit is found from
the last event at or before it.

A text is cut at two units into prefix, middle and suffix and written with sentinels as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm), or left
as it is (plain).  Which form and which cuts follows from a digest of seed and id alone.

Defined cases: null text is empty text, and empty text stays plain; text that holds a
sentinel stays plain, so that every output can be undone; a null id hashes as the empty
string; rows with repeated ids are cut row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import BLANKS, table

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Documents in a hundred that are transformed, and of these in a hundred that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Per kind of unit: the ASCII characters that change the class, and whether a gap is one unit.
UNITS = {"code_point": (BLANKS, False), "word": (BLANKS, True), "line": ("\n", True)}
BATCH_ROWS = 64
OUTPUT = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


class EventScan:
    """The events of texts, for one kind of unit.

    ``code_point``: every code point; ``word``: maximal runs of blanks and maximal runs of others;
    ``line``: what ends with a line feed, and a last line without one.
    """

    def __init__(self, unit: str = "code_point", sentinels: tuple[str, ...] = SENTINELS):
        if unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        if len(set(sentinels)) != 3 or not all(sentinels):
            raise ValueError("three different sentinels are needed")
        if any(a.endswith(b[:k]) for a in sentinels for b in sentinels for k in range(1, len(b) + (a != b))):
            raise ValueError("sentinels must not overlap, or outputs could not be undone")
        changing, self.whole_gaps = UNITS[unit]
        if any(c in s for c in changing for s in sentinels):
            raise ValueError("sentinels must not hold characters that change the class")
        self.unit, self.sentinels = unit, sentinels
        self.automaton = ahocorasick.Automaton()
        for c in changing:
            self.automaton.add_word(c, 0)
        for k, s in enumerate(sentinels):
            self.automaton.add_word(s, k + 1)
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Offsets of class-changing characters; (offset, number) of sentinels."""
        found = list(self.automaton.iter(text))
        at = np.fromiter((end for end, kind in found if not kind), np.int64)
        if len(at) == len(found):
            return at, []
        return at, [(end + 1 - len(self.sentinels[kind - 1]), kind - 1) for end, kind in found if kind]


class Ranks:
    """Sparse rank table of a text: where stretches of units begin, and how many units lie before them."""

    def __init__(self, scan: EventScan, at: np.ndarray, length: int):
        gap_from = np.concatenate([[0], at + 1])
        gap = np.concatenate([at, [length]]) - gap_from  # code points between two events, before the first and behind the last
        self.length, self.step = length, 1
        if scan.unit == "code_point":
            # Each gap has as many units as code points, each event is one.
            self.starts, units = gap_from, gap + 1
            units[-1] -= 1
        elif scan.unit == "line":
            # A gap and the line feed behind it are one unit; behind the last only what is left.
            self.starts, units = gap_from, np.ones(len(gap), np.int64)
            units[-1] = gap[-1] > 0
        else:
            # A gap that is not empty is a unit; so is a run of blanks, which goes on while gaps are empty.
            run = np.flatnonzero(gap[:-1] > 0) if len(at) else np.empty(0, np.int64)
            first = at[np.union1d(run, [0])] if len(at) else at
            self.starts = np.sort(np.concatenate([gap_from[gap > 0], first]))
            units = np.ones(len(self.starts), np.int64)
        self.before = np.cumsum(units) - units
        self.total = int(units.sum())

    def offset(self, rank: int) -> int:
        """Code points before the unit with so many units before it; all for the number of units."""
        if rank >= self.total:
            return self.length
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.starts[k]) + (rank - int(self.before[k])) * self.step


def transform(scan: EventScan, text: str, h: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, units of prefix and middle (None if plain), and output of one text."""
    at, held = scan.events(text)
    ranks = Ranks(scan, at, len(text))
    n = ranks.total
    if not text or held or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ranks.offset(low), ranks.offset(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = scan.sentinels
    if h[3] % 100 < suffix_first:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(scan: EventScan, output: str, form: str) -> str:
    """The text that an output was made of; raises where the output is none of this form."""
    if form == "plain":
        return output
    held = scan.events(output)[1]
    order = {"psm": [0, 1, 2], "spm": [1, 0, 2]}.get(form)
    if order is None or [k for _, k in held] != order or held[0][0] != 0:
        raise ValueError(f"not an output of form {form}")
    ends = [at for at, _ in held[1:]] + [len(output)]
    part = {k: output[at + len(scan.sentinels[k]) : end] for (at, k), end in zip(held, ends, strict=True)}
    return part[0] + part[2] + part[1]


def draws(id_col: str, seed: int) -> list:
    """Four unsigned 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_point", sentinels: tuple[str, ...] = SENTINELS, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain) and output of every row. Map-only."""
    EventScan(unit, sentinels)  # refuses wrong arguments here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan(unit, sentinels)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts, *h = (part.column(k).to_pylist() for k in range(1, 6))
                made = [transform(scan, t or "", x, rate, suffix_first) for t, x in zip(texts, zip(*h, strict=True), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *draws(id_col, seed)).mapInArrow(run, OUTPUT)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """df with ``restored``, the text rebuilt from output and form, in place of the output. Map-only; null output stays null."""
    rest = [c for c in df.columns if c not in (output_col, "restored")]
    kept = df.select(*rest, output_col)
    schema = df.select(*rest, F.col(output_col).alias("restored")).schema
    form_at, n = rest.index(form_col), len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan("line", sentinels)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [None if o is None else restore(scan, o, f) for o, f in zip(part.column(n).to_pylist(), part.column(form_at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string())], names=[*rest, "restored"])

    return kept.mapInArrow(run, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document transformed by code points, and rebuilt from its output."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digested = made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), "output")
    return restored(digested).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents
), cut AS (
  SELECT doc_id, text, n,
    ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM cut
), written AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM parts
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM written
"""
