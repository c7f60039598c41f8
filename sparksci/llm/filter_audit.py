"""Filter interaction audit: what each of five filters removes in every order of application.

Words are exploded and counted by (document, word), then by document for totals and
distinct words; the flags that need no words (capitals, symbols, copies, labels) are
outer-joined.  Which filters a document fails is a set of five, so 32 conditional counts
per part (and as many for good and for toxic documents) hold everything: the 120 orders
are computed from these counts, not from the documents.

Failure conditions: A under 200 words; B 100 * distinct words < 50 * words; C 100 *
capitals A-Z > 3 * code points; D any of ``#$%&*|``; E equal to the text of a smaller id
anywhere in the table.  Words are maximal runs of characters other than blanks.

Defined cases: null text is empty text (it fails A; B and C need more than nothing);
null part is the empty string; each row counts, so repeated rows count repeatedly, and a
row is no copy of rows with its own id; rows without id are copies of none and make none;
a document with several label rows is good (toxic) if any says 1.  No rows, no report.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparksci.llm.common import WORD_BREAK, table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SETS = 1 << len(FILTERS)


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, words, distinct_words) of (doc_id, text) that have words.

    Texts are dealt once by (id, text hash, partition read), which both counts then share: no shuffle of words,
    and repeated rows of one id are dealt apart. A null word marks each row, so that repeated rows divide out.
    """
    own = ["doc_id", "text_key", "dealt"]
    dealt = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.xxhash64("text").alias("text_key"), F.spark_partition_id().alias("dealt"), "text").repartition(*own)
    marked = F.concat(F.array(F.lit(None).cast("string")), F.split("text", WORD_BREAK))
    exploded = dealt.select(*own, F.explode(marked).alias("word")).where("word IS NULL OR word <> ''")
    by_word = exploded.groupBy(*own, "word").agg(F.count(F.lit(1)).alias("times"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("times")))
    totals = by_word.groupBy(*own).agg(F.sum(F.when(F.col("word").isNotNull(), F.col("times"))).alias("all"), rows.alias("rows"), F.count("word").alias("distinct_words"))
    return totals.groupBy("doc_id", "text_key").agg(F.max(F.expr("all div rows")).alias("words"), F.max("distinct_words").alias("distinct_words"))


def _fails(flag: str) -> Column:
    return F.col(flag).cast("int") * F.lit(1 << FILTERS.index(flag))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): how many documents of a part fail just the filters whose bits (A is 1) ``fails`` has.

    One row for each part and set that occurs and each kind of text group; sums of these are exact counts.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flagged = base.select(
        "doc_id", "part", F.xxhash64("text").alias("text_key"), F.sha2("text", 256).alias("digest"),
        (100 * capitals > MOST_CAPITALS_PERCENT * F.length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
    )
    # Repeated rows are one row with their number.
    flagged = flagged.groupBy("doc_id", "text_key", "digest", "part", "C", "D").agg(F.count(F.lit(1)).alias("n"))
    totals = word_totals(base).select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "words", "distinct_words")
    joined = flagged.join(totals, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    joined = joined.withColumn("A", words < LEAST_WORDS).withColumn("B", 100 * distinct < LEAST_DISTINCT_PERCENT * words)

    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # Rows without id have no label; their text keys spread them over the join's partitions.
    said = said.withColumn("l_key", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.col("text_key")).otherwise(F.lit(0).cast("long"))
    joined = joined.join(said, (F.coalesce("doc_id", F.lit(0).cast("long")) == F.col("l_id")) & (spread == F.col("l_key")) & F.col("doc_id").isNotNull(), "left")
    kind = ["digest", "part", "A", "B", "C", "D", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # A text's rows are combined where they are read, so a text that many rows share is a few rows behind the shuffle.
    same = joined.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without_id"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    same = same.withColumn("originals", F.col("n_without_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    either = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("originals").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("originals")).alias("n"))))
    split = same.select("part", "A", "B", "C", "D", "good", "toxic", either.alias("e")).select("part", "A", "B", "C", "D", "good", "toxic", "e.E", "e.n")
    fails = _fails("A") + _fails("B") + _fails("C") + _fails("D") + _fails("E")
    return split.select("part", fails.alias("fails"), "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))


def counts(failed: DataFrame) -> DataFrame:
    """One row a part: 32 conditional counts each of all, good and toxic documents, as arrays by set of filters."""
    columns = [F.sum(F.when(F.col("fails") == k, F.col(what)).otherwise(0)).alias(f"{what}_{k}") for what in ("n", "good", "toxic") for k in range(SETS)]
    wide = failed.groupBy("part").agg(*columns)
    return wide.select("part", *(F.array(*(F.col(f"{what}_{k}") for k in range(SETS))).alias(what) for what in ("n", "good", "toxic")))


def report(counted: DataFrame) -> DataFrame:
    """120 orders of five steps a part, from its counts alone."""
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))
    steps = counted.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = F.lit(0)
    earlier = F.lit(0)
    for k, f in enumerate(FILTERS):
        at = F.locate(f, F.col("filter_order"))
        place = place + F.when(at == F.col("step"), 1 << k).otherwise(0)
        earlier = earlier + F.when(at < F.col("step"), 1 << k).otherwise(0)
    steps = steps.withColumn("own", place).withColumn("earlier", earlier)
    own, before = F.col("own"), F.col("earlier")

    def total(what: str, condition) -> Column:
        picked = F.transform(F.col(what), lambda x, k: F.when(condition(k), x).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    def removed(k: Column) -> Column:
        return (k.bitwiseAND(own) != 0) & (k.bitwiseAND(before) == 0)

    # Of the orders of the filters that a document fails, each is first in equally many.
    orders_first = [0] + [120 // bin(k).count("1") for k in range(1, SETS)]
    weighed = F.transform(F.col("n"), lambda x, k: F.when(k.bitwiseAND(own) != 0, x * F.element_at(F.array(*map(F.lit, orders_first)), k + 1)).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda k: k.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda k: (k.bitwiseAND(own) != 0) & (k.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda k: k == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report over all documents: see the module's head and ``report``."""
    return report(counts(failures(docs, labels, id_col, text_col, part_col)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS first FROM split GROUP BY text
), flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < split.doc_id THEN 16 ELSE 0 END AS fails
  FROM split JOIN firsts USING (text) LEFT JOIN said USING (doc_id)
), sums AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k::INT, 1)) - 65))) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), removed AS (
  SELECT parts.part, filter_order, step, own,
    coalesce(sum(CASE WHEN fails & (own | coalesce(earlier, 0)::INT) = 0 THEN n END), 0) AS kept,
    coalesce(sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::INT = 0 THEN n END), 0) AS removed,
    coalesce(sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::INT <> 0 THEN n END), 0) AS redundant,
    coalesce(sum(CASE WHEN fails = own THEN n END), 0) AS unique_fails,
    coalesce(sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::INT = 0 THEN good END), 0) AS good_lost,
    coalesce(sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::INT = 0 THEN toxic END), 0) AS toxic_lost
  FROM (SELECT DISTINCT part FROM sums) parts JOIN steps ON true JOIN sums ON sums.part = parts.part
  GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM removed
"""
