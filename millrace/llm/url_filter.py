"""URL allow and block rules by a sort-merge range join over reversed-host keys.

A rule is a host and a path prefix. Its canonical key is the host's labels in reverse order, "/", and the path:
``org.example//es/``. All keys that begin with it form the interval from the key to the key followed by byte FF, which
no UTF-8 text contains. Intervals of prefixes nest, so a sorted sweep needs a stack of the rules that are open. Here the
stack is linked: each rule knows its parent, so an interval's start makes the rule the top of the stack and its end
makes its parent the top. A URL has one key for each suffix of its host (as many as the longest rule host has labels);
its rule is on top of the stack where the sweep passes the key.

The sweep is distributed: keys and interval ends are range partitioned together, with ties of a key dealt by a hash, so
one host or URL with a third of all rows spreads over many tasks. The stack's top at the end of each partition is handed
to the next. Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, inline, table

RULE_SCHEMA = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", labels), F.lit("/"), path).cast("binary")


def _rule_ends(rules: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals: key, and the rule that tops the stack from there on (null: none)."""
    own = (
        rules.select(F.translate(F.coalesce("host", F.lit("")), string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(_key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    )
    prefixes = own.select("key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n")).select("key", F.substring("key", F.lit(1), F.col("n")).alias("prefix"))
    parents = prefixes.join(own.select(F.col("key").alias("prefix"), F.col("top").alias("parent")), "prefix").groupBy("key").agg(F.max_by("parent", F.length("prefix")).alias("parent"))
    ends = own.select("key").join(parents, "key", "left").select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.col("parent").alias("top"))
    return own.unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none fits), verdict (the rule's, else ``default``).

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; of
    several the longest (host and path together) wins, and of rules for the same host and path the larger verdict
    ("block" before "allow"). A null or malformed URL has an empty host and path and falls under no rule unless one has
    an empty host. Repeated pages give repeated rows; no pages, no rows; no rules, the default for all. Other columns
    are ignored.
    """
    labels = rules.agg(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\.")))).first()[0] or 1
    host, path = split_url(F.col(url))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("times"))
    reverse = F.reverse(F.split("host", r"\."))
    points = base.select("page_id", "host", "path", "times", F.explode(F.sequence(F.lit(1), F.least(F.size(reverse), F.lit(labels)))).alias("n")).select("page_id", "host", "path", "times", _key(F.slice(reverse, F.lit(1), F.col("n")), F.col("path")).alias("key"))
    ends = _rule_ends(rules)
    top_type = dict(ends.dtypes)["top"]
    swept = (
        points.withColumn("mark", F.lit(None).cast(f"struct<top:{top_type}>"))
        .unionByName(ends.select(F.struct("top").alias("mark"), "key"), allowMissingColumns=True)
        .withColumn("tie", F.when(F.col("mark").isNull(), F.xxhash64("page_id", "host", "path")))
        .repartitionByRange(F.col("key").asc(), F.col("tie").asc_nulls_first())
        .withColumn("part", F.spark_partition_id())
    )
    swept = cut(swept, "url-sweep")
    # the top of the stack that each partition takes over: the last end in any earlier one; a row for each partition
    last = swept.groupBy("part").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("key"))).alias("mark"))
    taken = last.select("part", F.last("mark", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("taken"))
    sweep = Window.partitionBy("part").orderBy(F.col("key").asc(), F.col("tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        swept.withColumn("open", F.last("mark", True).over(sweep))
        .filter("mark is null")
        .join(F.broadcast(taken), "part", "left")  # a row for each partition of the sweep
        .select("page_id", "host", "path", "times", F.coalesce("open", "taken")["top"].alias("top"))
        .groupBy("page_id", "host", "path")
        .agg(F.max("top").alias("top"), F.first("times").alias("times"))
    )
    return found.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under RULES; what no rule fits is allowed."""
    return judge_urls(table(spark, sf_dir, "pages"), inline(spark, ("host", "path", "verdict"), RULES))


SQL = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
