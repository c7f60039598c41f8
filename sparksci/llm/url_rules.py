"""URL filtering by association rules mined with FP-growth, under a list of fixed rules.

A URL is a set of tokens.  FP-growth over labelled URLs finds frequent token sets.  The
rules ``tokens => block`` and ``tokens => allow`` are pruned by support, by confidence,
by how far the confidence lies above the class's share of all labelled URLs (in standard
errors of that share), and where a shorter rule inside is as sure.  Each rule is posted
under its rarest token in an inverted index; a URL meets the rules posted under its
tokens and fits those whose tokens it holds in full.  The rule with the highest lift
decides.  Fixed rules (host and path prefix, the longest that fits) come before mined
ones.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no
fixed rule; where no rule fits, and without labels, the verdict is allow; repeated rows
get the same verdict each; of equal lifts block wins; rows without id are judged too.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import ascii_lower, table, written

POLICY = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MIN_SUPPORT = 0.0005
#: Labelled rows of its class that a rule rests on at least; in small tables this is the larger share.
MIN_ROWS = 20
MIN_CONFIDENCE = 0.5
#: Standard errors that a rule's confidence lies above the share of its class at least.
MIN_Z = 2.0
#: Rules up to which the index is broadcast; a larger one is joined by shuffle.
SMALL_INDEX = 50_000
RULES = "rule_id long, tokens array<string>, anchor string, verdict string, confidence double, lift double, support double"
CLASSES = {"label=block": "block", "label=allow": "allow"}


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def policy_rule(host: Column, path: Column, policy: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fixed rule that fits, and its verdict; null where none does. The list is configuration, not data."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(policy, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path parts and query keys, each with its place; numbers are one token."""
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.split(ascii_lower(path_of(url)), r"[/.]"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.regexp_replace(ascii_lower(x), "(?s)=.*", "")))
    every = F.filter(F.concat(host, path, query), lambda t: F.length(t) > 2)
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array().cast("array<string>"))


def _baskets(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, bad) of the labelled URLs that have tokens, by classes of tokens; and the classes (token, class).

    Tokens that the very same rows hold tell the same, so a class of them is mined as its least token. Which rows
    hold a token is compared by their number and two sums of hashes. A rule never needs two tokens of a class: the
    rule without one of them is as sure and shorter.
    """
    rows = labelled.select(tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).where(F.size("tokens") > 0)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    held = rows.select("row", "bad", F.explode("tokens").alias("token"))
    part = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    marks = held.groupBy("token").agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b"))
    first = marks.groupBy("n", "a", "b").agg(F.min("token").alias("class"))
    classes = written(marks.join(first, ["n", "a", "b"]).select("token", "class"), "url-classes")
    merged = held.join(classes, "token").groupBy("row", "bad").agg(F.collect_set("class").alias("tokens"))
    return written(merged.select(F.array_sort("tokens").alias("tokens"), "bad"), "url-baskets"), classes


def _spelled(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules over classes as rules over tokens: one for each choice of a token from every class."""
    members = classes.groupBy("class").agg(F.collect_list("token").alias("members"))
    own = rules.select("verdict", "tokens", F.explode("tokens").alias("class")).join(members, "class").groupBy("tokens", "verdict").agg(F.collect_list("members").alias("members"))
    none = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("members", none, lambda done, m: F.flatten(F.transform(done, lambda d: F.transform(m, lambda t: F.concat(d, F.array(t))))))
    return rules.join(own, ["tokens", "verdict"]).withColumn("tokens", F.explode(choices)).withColumn("tokens", F.array_sort("tokens")).drop("members")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_z: float = MIN_Z, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules (RULES' columns) from rows (url, bad), all of them."""
    spark = labelled.sparkSession
    baskets, classes = _baskets(labelled)
    n, bad = baskets.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    if not n:
        return spark.createDataFrame([], RULES)
    label = F.when(F.col("bad"), "label=block").otherwise("label=allow")
    # Half a row less, so that rounding never asks for one row more.
    least = (max(float(min_rows), min_support * n) - 0.5) / n
    if least >= 1:
        return spark.createDataFrame([], RULES)
    model = FPGrowth(itemsCol="items", minSupport=max(least, 0.0), minConfidence=min_confidence).fit(baskets.select(F.concat("tokens", F.array(label)).alias("items")))
    share = {"block": bad / n, "allow": 1 - bad / n}
    verdict = F.element_at(F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair)), F.element_at("consequent", 1))
    base = F.when(F.col("verdict") == "block", share["block"]).otherwise(share["allow"])
    z = (F.col("confidence") - base) / F.sqrt(base * (1 - base) / F.col("rows"))
    found = (
        model.associationRules.where(F.element_at("consequent", 1).isin(*CLASSES) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, CLASSES))))
        .select(F.array_sort("antecedent").alias("tokens"), verdict.alias("verdict"), "confidence", "support", F.round(F.col("support") * n / F.col("confidence")).alias("rows"))
        .where((base < 1) & (z >= min_z))
        .select("tokens", "verdict", "confidence", "support", (F.col("confidence") / base).alias("lift"))
    )
    found = written(found, "url-rules")
    # A rule looks up the shorter ones inside it: its own subsets, never all other rules.
    size = F.size("tokens")
    subsets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2.0), size).cast("long") - 2), lambda m: F.filter("tokens", lambda t, i: F.getbit(m, i) == 1))
    parts = found.where(size > 1).select("tokens", "verdict", "confidence", F.explode(subsets).alias("short"))
    shorter = found.select(F.col("tokens").alias("short"), "verdict", F.col("confidence").alias("sure"))
    beaten = parts.join(shorter, ["short", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    kept = found.join(beaten, ["tokens", "verdict"], "left_anti")
    kept = _spelled(kept, classes)
    often = classes.join(baskets.select(F.explode("tokens").alias("class")).groupBy("class").agg(F.count("*").alias("often")), "class").select("token", "often")
    anchors = kept.select("tokens", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens").agg(F.min(F.struct("often", "token"))["token"].alias("anchor"))
    rules = kept.join(anchors, "tokens").select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "anchor", "verdict", "confidence", "lift", "support")
    return written(rules, "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that hold all tokens of some rule, with the verdict, confidence and lift of the rule that decides."""
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("wanted"), "verdict", "confidence", "lift")
    if index.count() <= SMALL_INDEX:
        index = F.broadcast(index)
    own = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("own", tokens(F.col("url")))
    fits = own.select("url", "own", F.explode("own").alias("token")).join(index, "token").where(F.size(F.array_except("wanted", "own")) == 0)
    best = F.max(F.struct("lift", "verdict", "confidence"))  # of equal lifts "block" is the greater word
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.verdict", "best.confidence", "best.lift")


def judge(pages: DataFrame, rules: DataFrame, policy: list[tuple[str, str]] = POLICY, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict for every row; and verdict, confidence and lift of the mined rule that fits best."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    found = matched(rows, rules).withColumnRenamed("verdict", "mined")
    rule, says = policy_rule(F.col("host"), F.col("path"), policy)
    told = rows.join(found, "url", "left").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined", "confidence", "lift")
    return told.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, "mined", F.lit("allow")).alias("verdict"), "mined", "confidence", "lift")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages that show a labelled document: its number is the last whole number in the path."""
    shown = pages.select("url", F.try_to_number(F.regexp_extract(path_of(F.col("url")), "([0-9]{1,18})[^0-9]*$", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return shown.join(marks, "doc_id").select("url", "bad")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the fixed rules and by rules mined from all labelled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, mine(labelled_urls(pages, table(spark, sf_dir, "labels"))))
    return out.select("page_id", "host", "path", "rule", "verdict", "mined", F.round("confidence", 4).alias("confidence"), F.round("lift", 4).alias("lift"))


# All token sets of the labelled URLs are counted, without FP-growth's tree; these URLs have fewer tokens than MINED_TOKENS.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages
), held AS (
  SELECT page_id, url, host, path, list_sort(list_distinct(list_filter(list_concat(
           list_transform(string_split(host, '.'), lambda x: 'h:' || x),
           list_transform(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[/.]'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
           list_transform(string_split(query, '&'), lambda x: 'q:' || regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s)=.*', ''))
         ), lambda t: length(t) > 2))) AS own
  FROM parts
), fixed AS (
  SELECT page_id, (SELECT max_by(r.rule, length(r.rule)) FROM (VALUES ('net', '/', 'net/'), ('example.net', '/en/', 'example.net/en/'),
           ('example.com', '/de/', 'example.com/de/'), ('org', '/fr/', 'org/fr/')) r(name, start, rule)
         WHERE (host = r.name OR ends_with(host, '.' || r.name)) AND starts_with(path, r.start)) AS rule
  FROM (SELECT DISTINCT page_id, host, path FROM held)
), marks AS (
  SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels GROUP BY doc_id
), baskets AS (
  SELECT own, m.bad FROM held JOIN marks m ON m.doc_id = try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT) WHERE len(own) > 0
), whole AS (
  SELECT count(*) AS n, avg(bad) AS share FROM baskets
), sets AS (
  SELECT unnest(list_transform(range(1, (1 << len(own))::BIGINT), lambda m: list_filter(own, lambda t, i: ((m >> (i - 1)) & 1) = 1))) AS tokens, bad FROM baskets
), counted AS (
  SELECT tokens, count(*) AS n, sum(bad) AS bad FROM sets GROUP BY tokens
), classes AS (
  SELECT c.tokens, c.n, c.bad AS own, 'block' AS verdict, w.share AS base FROM counted c, whole w
  UNION ALL SELECT c.tokens, c.n, c.n - c.bad, 'allow', 1 - w.share FROM counted c, whole w
), sure AS (
  SELECT c.tokens, c.verdict, c.own / c.n AS confidence, (c.own / c.n) / c.base AS lift FROM classes c, whole w
  WHERE c.own >= greatest(20, 0.0005 * w.n) AND c.own / c.n >= 0.5 AND c.base < 1 AND (c.own / c.n - c.base) / sqrt(c.base * (1 - c.base) / c.n) >= 2
), rules AS (
  SELECT * FROM sure s WHERE NOT EXISTS (SELECT 1 FROM sure x WHERE x.verdict = s.verdict AND len(x.tokens) < len(s.tokens) AND list_has_all(s.tokens, x.tokens) AND x.confidence >= s.confidence)
), best AS (
  SELECT u.url, max({'lift': r.lift, 'verdict': r.verdict, 'confidence': r.confidence}) AS b
  FROM (SELECT DISTINCT url, own FROM held WHERE url IS NOT NULL) u JOIN rules r ON list_has_all(u.own, r.tokens) GROUP BY u.url
)
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(CASE f.rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END, b.b.verdict, 'allow') AS verdict,
       b.b.verdict AS mined, round(b.b.confidence, 4) AS confidence, round(b.b.lift, 4) AS lift
FROM held h JOIN fixed f ON f.page_id = h.page_id LEFT JOIN best b ON b.url = h.url
"""
