"""URL filtering by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the host suffixes and path prefixes that rules could
name, every expression is hashed, expressions and rules are equi-joined on a
short prefix of the digest, and a match counts once the full digests agree.
Of the rules that fit a URL the longest (host and path together) decides; at
equal length ``block`` goes before ``allow``, then the longer host.

Edge cases: a null URL or one without ``://`` has an empty host and path and no
rule; repeated rows are all answered; rule rows with a null or empty host, a
null path or an unknown verdict are an error; an empty table gives an empty
result.  Other columns of the table are never touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import any_key, cut, lower_ascii, read, replicated

#: Rules that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000

QUERY_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``: after the first ``://`` up to one of ``/?#``, then up to one of ``?#``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return urls.withColumns({"host": lower_ascii(F.regexp_extract(text, "://([^/?#]*)", 1)), "path": F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)})


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, verdict)`` with their digests; raises on rules that can't be judged."""
    bad = rules.filter("host IS NULL OR host = '' OR path IS NULL OR verdict IS NULL OR verdict NOT IN ('allow', 'block')").count()
    if bad:
        raise ValueError(f"{bad} rules have no host, no path or an unknown verdict")
    rule = F.concat(lower_ascii(F.col("host")), F.col("path"))
    return rules.select(
        F.sha2(rule, 256).alias("rule_digest"), rule.alias("rule"), "verdict", F.length(rule).alias("size"), F.length("host").alias("host_size"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_size"),
    ).withColumn("prefix", F.substring("rule_digest", 1, 8)).dropDuplicates(["rule_digest", "verdict"])


@any_key("host", "path", "rule", "verdict")
def filter_urls(urls: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``urls``: ``key``, host, path, the deciding rule or null, and the verdict (``default`` without a rule)."""
    compiled = cut(compile_rules(rules))
    shape = compiled.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_size")).alias("paths"), F.count("*").alias("n")).first()
    labels, paths, n_rules = [F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>") for xs in (shape["labels"], shape["paths"])] + [shape["n"]]

    rows = host_and_path(urls.select(key, F.col(url).alias("_url")), "_url").groupBy(key, "_url", "host", "path").agg(F.count("*").alias("_copies"))
    parts = rows.withColumn("_parts", F.split("host", r"\."))
    suffix = F.transform(F.filter(labels, lambda k: (k <= F.size("_parts")) & (F.col("host") != "")), lambda k: F.array_join(F.slice("_parts", F.size("_parts") - k + 1, k), "."))
    prefix = F.transform(F.filter(paths, lambda k: k <= F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    wide = parts.withColumns({"_suffix": suffix, "_prefix": prefix})
    digests = F.flatten(F.transform("_suffix", lambda h: F.transform("_prefix", lambda p: F.sha2(F.concat(h, p), 256))))
    # One more expression, which no rule has, keeps the URLs that no rule fits; it is different for each row, so that they spread.
    expanded = wide.withColumn("_digest", F.explode(F.concat(F.array(F.concat(F.lit("-"), F.xxhash64(key, "_url").cast("string"))), digests)))
    expanded = expanded.select(key, "_url", "host", "path", "_copies", "_digest", F.substring("_digest", 1, 8).alias("prefix"))
    table = compiled.select("prefix", "rule_digest", "rule", "verdict", "size", "host_size")
    joined = expanded.join(F.broadcast(table) if n_rules <= BROADCAST_RULES else table, "prefix", "left")
    confirmed = F.when(F.col("_digest") == F.col("rule_digest"), F.struct("size", (F.col("verdict") == "block").alias("block"), "host_size", "rule", "verdict"))
    best = joined.groupBy(key, "_url", "host", "path", "_copies").agg(F.max(confirmed).alias("best"))
    return replicated(best, "_copies").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(QUERY_RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules, "page_id")


ORACLE = """
WITH rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""

QUERIES = {"op5_url_rules": op5_url_rules}
ORACLES = {"op5_url_rules": ORACLE}
