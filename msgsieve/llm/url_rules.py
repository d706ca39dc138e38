"""URL filter: listed rules first, then association rules mined from judged URLs.

* A listed rule (``host/path``) fits its host and all subdomains if the path of the URL
  starts with the rule's; the longest that fits wins.
* Where none fits, rules mined by FP-growth decide.  A transaction is the set of tokens of
  a judged URL (scheme, host labels, words of path and query) and its verdict.  Rules from
  at most ``MOST_TOKENS`` tokens to a verdict stay if they have the least support and
  confidence, and if no rule on a part of their tokens is as confident.
* Tokens that occur in exactly the same transactions are one item to the miner: otherwise a
  site whose pages share a deep path has a frequent set for each subset of that path.
* An inverted index files each mined rule under its rarest item.  Different sets of items,
  not URLs, are looked up in it and checked for the other items; the most confident rule
  decides, then the one of larger support, then one that allows.  A URL that no rule fits
  is allowed.

Only built-in functions and Spark's own FP-growth work on the data.  Joins carry no hint:
written tables have known sizes, so Spark broadcasts those below its limit and splits skewed
partitions of the others.

Cases: a null URL, or one without ``://``, has an empty host and path and no tokens, so it is
allowed; repeated rows are judged alike; tokens are counted once a URL; without judged URLs
nothing is mined and all is allowed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.llm.tables import read
from msgsieve.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
MIN_SUPPORT = 0.005  # of all judged URLs
MIN_CONFIDENCE = 0.8
MOST_TOKENS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VERDICT_ITEM = "="  # no token begins with it


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Sorted different tokens; numbers are left out, as they tell pages apart and not kinds of pages."""
    rest = _after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)

    def named(prefix: str, words: Column) -> Column:
        kept = F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
        return F.transform(kept, lambda w: F.concat(F.lit(prefix), w))

    def words(text: Column) -> Column:
        return F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0))

    scheme = F.array(F.concat(F.lit("scheme:"), _lower(F.substring(url, F.lit(1), F.locate("://", url) - 1))))
    parts = [scheme, named("host:", F.split(host_of(url), r"\.", -1)), named("path:", words(path_of(url))),
             named("query:", words(query))]
    found = F.sort_array(F.array_distinct(F.concat(*parts)))
    return F.when(rest.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null.  ``rules`` is a list in the program, not a table."""

    def fits(rule: str) -> Column:
        name, slash, start = rule.partition("/")
        return F.concat(F.lit("."), host).endswith("." + name) & path.startswith(slash + start)

    by_length = sorted(rules, key=lambda r: len(r[0]))
    return reduce(lambda found, r: F.when(fits(r[0]), F.lit(r[0])).otherwise(found), by_length,
                  F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    return reduce(lambda found, r: F.when(rule == r[0], F.lit(r[1])).otherwise(found), rules, F.lit(None).cast("string"))


def frequent_items(transactions: DataFrame, least: int) -> DataFrame:
    """token and item: tokens in at least ``least`` transactions; those of the same transactions share an item.

    Equal counts and equal sums of 64-bit hashes stand for equal sets of transactions.
    """
    key = F.xxhash64("tokens").cast("decimal(20,0)")
    counted = transactions.groupBy("tokens").agg(F.count("*").alias("n")).select(
        F.explode("tokens").alias("token"), "n", (key * F.col("n")).cast("decimal(38,0)").alias("key"))
    each = counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("key").alias("key")).where(F.col("n") >= least)
    alike = each.groupBy("n", "key").agg(F.collect_list("token").alias("tokens"))
    return alike.select(F.explode("tokens").alias("token"), F.array_min("tokens").alias("item"), "n")


def _item_sets(token_sets: DataFrame, items: DataFrame) -> DataFrame:
    """tokens and the frequent items among them, for each different set that has some."""
    exploded = token_sets.select("tokens", F.explode("tokens").alias("token"))
    return exploded.join(items, "token").groupBy("tokens").agg(F.sort_array(F.collect_set("item")).alias("items"))


def mine(judged: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE,
         most: int = MOST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, verdict, confidence, support, rarest) and the table of token, item and n they speak of.

    ``judged`` has ``url`` and ``verdict``; rows without a verdict are not used.
    """
    transactions = cut_lineage(judged.where("verdict IS NOT NULL").select(tokens_of(F.col("url")).alias("tokens"), "verdict"),
                               "transactions")
    total = transactions.count()
    least = F.ceil(F.lit(support) * F.lit(float(total)))
    items = cut_lineage(frequent_items(transactions, least), "items")
    sets = cut_lineage(_item_sets(transactions.select("tokens").distinct(), items), "item-sets")
    label = F.array(F.concat(F.lit(VERDICT_ITEM), F.col("verdict")))
    baskets = transactions.join(sets, "tokens", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), label).alias("items"))
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if total:
        miner = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence)
        found = miner.fit(baskets).associationRules
        rules = found.where(F.col("consequent")[0].startswith(VERDICT_ITEM) & (F.size("antecedent") <= most)).select(
            F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"),
            "confidence", "support")
    else:
        rules = judged.sparkSession.createDataFrame([], schema)
    rules = cut_lineage(_without_needless(cut_lineage(rules, "mined")), "rules")
    counts = items.groupBy("item").agg(F.max("n").alias("n"))
    rarest = rules.select("*", F.explode("antecedent").alias("item")).join(counts, "item").groupBy(*rules.columns).agg(
        F.min(F.struct("n", "item"))["item"].alias("rarest"))
    return cut_lineage(rarest, "rule-index"), items


def _without_needless(rules: DataFrame) -> DataFrame:
    """Rules of which no part of the tokens speaks as surely; such a part has no less support, so it always wins."""
    whole = F.col("antecedent")
    parts = F.array_union(F.transform(whole, lambda x: F.array(x)), F.transform(whole, lambda x: F.array_remove(whole, x)))
    smaller = rules.select(whole, F.col("verdict"), F.col("confidence"), F.explode(parts).alias("part")).where(
        (F.size("part") > 0) & (F.size("part") < F.size(whole)))
    surest = rules.groupBy("antecedent").agg(F.max("confidence").alias("surest")).withColumnRenamed("antecedent", "part")
    needless = smaller.join(surest, "part").where("surest >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(needless, ["antecedent", "verdict"], "left_anti")


def match(token_sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """tokens and verdict of each different set of tokens that a mined rule fits."""
    sets = _item_sets(token_sets, items)
    looked_up = sets.select("tokens", "items", F.explode("items").alias("rarest")).join(rules, "rarest")
    fitting = looked_up.where(F.forall("antecedent", lambda x: F.array_contains(F.col("items"), x)))
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == ALLOW).alias("allows")))
    return fitting.groupBy("tokens").agg(best.alias("best")).select(
        "tokens", F.when(F.col("best.allows"), ALLOW).otherwise(BLOCK).alias("mined"))


def judge(pages: DataFrame, listed: Sequence[tuple[str, str]] = RULES, judged: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    Rules are mined from ``judged`` (url, verdict), or else from the rows that a listed rule fits.
    """
    url = F.col("url")
    seen = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("rule", listed_rule(F.col("host"), F.col("path"), listed))
    seen = cut_lineage(seen.withColumn("verdict", verdict_of(F.col("rule"), listed)), "pages")
    rules, items = mine(seen.select("url", "verdict") if judged is None else judged)
    left = cut_lineage(seen.where("rule IS NULL").withColumn("tokens", tokens_of(url)), "pages-left")
    mined = cut_lineage(match(left.select("tokens").distinct(), rules, items), "mined-verdicts")
    by_method = left.join(mined, "tokens", "left").withColumn("verdict", F.coalesce("mined", F.lit(ALLOW)))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return seen.where("rule IS NOT NULL").select(columns).unionByName(by_method.select(columns))


def op13_association_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read(spark, folder, "pages"))


# All sets of one to three frequent tokens stand in for FP-growth, which finds the same ones.
SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT r, page_id, url, rest,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), listed(rule, verdict, rule_host, rule_path) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), fitting AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN listed ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path) GROUP BY r
), words AS (
  SELECT r, 'host:' || w AS token FROM (SELECT r, unnest(string_split(host, '.')) AS w FROM parts) WHERE w <> '' AND NOT regexp_full_match(w, '[0-9]+')
  UNION ALL SELECT r, 'path:' || w FROM (SELECT r, unnest(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM parts) WHERE NOT regexp_full_match(w, '[0-9]+')
  UNION ALL SELECT r, 'query:' || w FROM (SELECT r, unnest(regexp_extract_all(translate(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM parts) WHERE NOT regexp_full_match(w, '[0-9]+')
  UNION ALL SELECT r, 'scheme:' || translate(substr(url, 1, strpos(url, '://') - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM parts WHERE rest IS NOT NULL
), least AS (SELECT ceil(0.005::DOUBLE * count(*)) AS n FROM fitting),
frequent AS (
  SELECT token FROM (SELECT DISTINCT r, token FROM words) SEMI JOIN fitting USING (r) GROUP BY token HAVING count(*) >= (SELECT n FROM least)
), tokens AS (SELECT DISTINCT r, token FROM words SEMI JOIN frequent USING (token)),
sets AS (
  SELECT r, token AS s FROM tokens
  UNION ALL SELECT r, a.token || ' ' || b.token FROM tokens a JOIN tokens b USING (r) WHERE a.token < b.token
  UNION ALL SELECT r, a.token || ' ' || b.token || ' ' || c.token FROM tokens a JOIN tokens b USING (r) JOIN tokens c USING (r)
    WHERE a.token < b.token AND b.token < c.token
), counted AS (
  SELECT s, verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY s) AS all_n FROM sets JOIN fitting USING (r) GROUP BY s, verdict
), rules AS (
  SELECT s, verdict, n::DOUBLE / all_n::DOUBLE AS confidence, n FROM counted WHERE n >= (SELECT n FROM least) AND n::DOUBLE / all_n::DOUBLE >= 0.8::DOUBLE
), matched AS (
  SELECT r, arg_max(verdict, (confidence, n, verdict = 'allow')) AS verdict FROM sets JOIN rules USING (s) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(f.verdict, m.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fitting f USING (r) LEFT JOIN matched m USING (r)
"""
