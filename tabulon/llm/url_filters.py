"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule has a host, a path and an action. It fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's; the longest fitting rule decides. Each distinct URL is
expanded into the expressions (host suffix, path prefix) that some rule could have; those are joined
with the rules on the first ``PREFIX`` hex digits of a SHA-256 digest, the full digests confirm a
match, and precedence picks the rule. All in DataFrame functions.

Only suffixes with as many labels, and prefixes as long, as some rule has are made, so the number of
expressions of a URL is bounded by the rules and not by its length. URLs are made distinct before
they are expanded, so copies of one URL cost one row; the optimiser broadcasts the rules only when
their known size is below its threshold, and otherwise splits skewed digests. Null URLs, which no rule
fits, are dealt out by the other columns in the last join.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty path, and no rule
fits it; of rules with equally long expressions the longer host goes first, then ``block`` before
``allow``; a rule listed twice counts once; repeated pages are judged each; other columns of any type and name
are passed on (those that can be hashed deal out null URLs), but for host, path, rule and verdict, which are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tabulon.llm.session import cut, table

PREFIX = 8
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Literal rows, of a size that the optimiser knows."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, action)")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """hit_url, rule and verdict of those ``urls`` (a column url, distinct) that a rule fits. ``rules``: host, path,
    action."""
    rules = rules.distinct()
    depths = rules.agg(F.collect_set(F.size(F.split("host", "[.]")))).scalar()
    lengths = rules.agg(F.collect_set(F.length("path"))).scalar()
    host, path = host_and_path(F.col("url"))
    split = urls.select("url", host.alias("host"), path.alias("path")).withColumn("labels", F.size(F.split("host", "[.]")))
    hosts = split.filter("host <> ''").select("url", "host", "path", "labels", F.explode(depths).alias("n")).filter("n <= labels")
    expressions = hosts.select("url", F.expr("substring_index(host, '.', -n)").alias("suffix"), "path", F.explode(lengths).alias("m")).filter("m <= length(path)")
    expressions = expressions.select("url", "suffix", F.expr("substring(path, 1, m)").alias("prefix"))
    expressions = expressions.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, PREFIX))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action", _digest(F.col("host"), F.col("path")).alias("rule_digest"))
    known = known.withColumn("short", F.substring("rule_digest", 1, PREFIX))
    hit = expressions.join(known, "short").filter("digest = rule_digest AND suffix = rule_host AND prefix = rule_path")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("action") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    best = hit.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("hit_url"), F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    return best.withColumn("verdict", F.col("action")).drop("action")


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of the column url, in place of columns of these names."""
    host, path = host_and_path(F.col("url"))
    # a written table, so that the optimiser can split the task of a frequent URL
    found = cut(fitting_rules(pages.select("url").distinct(), rules))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    others = [f"`{f.name}`" for f in pages.schema if f.name in kept and _hashable(f.dataType)]
    # no URL that a rule fits is without "://"
    key = F.coalesce("url", F.concat(F.lit("null "), F.xxhash64(*others).cast("string")))
    rows = pages.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), host.alias("host"), path.alias("path"), key.alias("key"))
    joined = rows.join(found, F.col("key") == F.col("hit_url"), "left")
    return joined.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


#: The same rows in DuckDB, rule by rule.
SQL = r"""
WITH rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT DISTINCT url, host, path FROM parts),
best AS (SELECT url, arg_max(rh || rp, (length(rh) + length(rp)) * 1000 + length(rh)) AS rule, arg_max(action, (length(rh) + length(rp)) * 1000 + length(rh)) AS action
  FROM urls, rules WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (url)
"""
