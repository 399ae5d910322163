"""Spans, identities, validation, counting and rewriting over texts and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import paths_sql as P
from ..operators.rounds import shared_folder
from ..sources import source_tree
from .common import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT doc_id, strlen(text) AS byte_length, sha256(text) AS sha256 FROM documents")
def source_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", T.identity(F.col("text")).alias("i")).select("doc_id", "i.*")


_PREFIX = "left(text, CAST(instr(text, 'the ') AS BIGINT) - 1)"


@query(f"""SELECT doc_id, strlen(p) AS byte_offset, length(p) - length(replace(p, chr(10), '')) + 1 AS line, strlen(CASE WHEN contains(p, chr(10)) THEN regexp_extract(p, '\\n([^\\n]*)$', 1) ELSE p END) + 1 AS col
FROM (SELECT doc_id, {_PREFIX} AS p FROM documents WHERE instr(text, 'the ') > 0)""")
def span_line_column(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").filter(F.instr("text", "the ") > 0)
    rows = rows.withColumn("p", F.col("text").substr(F.lit(1), F.instr("text", "the ") - 1))
    return rows.select("doc_id", T.byte_offset(F.col("text"), "the ").cast("long").alias("byte_offset"), T.line_of(F.col("p")).cast("long").alias("line"), T.column_of(F.col("p")).cast("long").alias("col"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, 1 + doc_id % 3 AS line, 2 + doc_id % 3 AS end_line FROM documents)
SELECT doc_id, n, length(content) AS size FROM l JOIN s USING (doc_id) WHERE line <= n AND end_line >= n""")
def span_line_overlap(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).select("doc_id", (F.col("i") + 1).cast("long").alias("n"), "content")
    spans = docs.select("doc_id", (1 + F.col("doc_id") % 3).alias("line"), (2 + F.col("doc_id") % 3).alias("end_line"))
    return P.overlapping_lines(spans, lines, ["doc_id"]).select("doc_id", "n", F.length("content").alias("size"))


@query("""SELECT page_id, regexp_matches(name, '^[A-Za-z0-9_.-]+\\.html$') AND length(name) <= 160 AS name_ok, length(html) BETWEEN 1 AND 1000000 AND trim(html) <> '' AS source_ok, TRY_CAST(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT) AS number
FROM (SELECT page_id, html, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages)""")
def request_validation(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1).alias("name"))
    ok = F.coalesce((F.length("name") <= 160) & F.col("name").rlike(r"^[A-Za-z0-9_.-]+\.html$"), F.lit(False))
    return rows.select("page_id", ok.alias("name_ok"), T.valid_source(F.col("html")).alias("source_ok"), F.expr(r"try_cast(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT)").alias("number"))


_FLAGS = {"has_symbols": "contains(line, '%%%')", "has_pipe": "contains(line, ' | ')", "has_digit": "contains(line, '0')"}


@query(f"""SELECT lang, source, count(*) AS n_lines, sum(words) AS n_words, max(words) AS most_words, {", ".join(f"bool_or({e}) AS {k}" for k, e in _FLAGS.items())}
FROM (SELECT lang, source, line, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY lang, source""")
def keyword_features(spark, d):
    lines = table(spark, d, "documents").select("doc_id", "lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    per_doc = lines.groupBy("lang", "source").agg(F.count("*").alias("n_lines"), F.sum(words).alias("n_words"), F.max(words).alias("most_words"), *(F.expr(f"bool_or({e})").alias(k) for k, e in _FLAGS.items()))
    return per_doc


@query("""SELECT doc_id, feature, value FROM (SELECT doc_id, unnest(['symbols', 'pipes', 'breaks']) AS feature, unnest([(length(text) - length(replace(text, '%%%', ''))) // 3, (length(text) - length(replace(text, ' | ', ''))) // 3, length(text) - length(replace(text, chr(10), ''))]) AS value FROM documents) WHERE value <> 0""")
def feature_active_map(spark, d):
    count = lambda s: ((F.length("text") - F.length(F.replace("text", F.lit(s), F.lit("")))) / len(s)).cast("long")
    features = F.create_map(F.lit("symbols"), count("%%%"), F.lit("pipes"), count(" | "), F.lit("breaks"), count("\n"))
    return table(spark, d, "documents").select("doc_id", F.explode(T.active(features)).alias("feature", "value"))


@query("""WITH n AS (SELECT l_orderkey, CAST(min(l_partkey) AS VARCHAR) AS a, CAST(max(l_suppkey) * 37 AS VARCHAR) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a, b, length(a) < length(b) OR (length(a) = length(b) AND a < b) AS less FROM n""")
def decimal_string_compare(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").cast("string").alias("a"), (F.max("l_suppkey") * 37).cast("string").alias("b"))
    return rows.withColumn("less", T.less(F.col("a"), F.col("b")))


@query("""SELECT source, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, round(sum(len(string_split(text, chr(10)))) / 1000, 3) AS kloc FROM documents GROUP BY ROLLUP (source)""")
def loc_rollup(spark, d):
    return M.line_counts(table(spark, d, "documents"), "source", "text")


@query("""SELECT doc_id FROM documents WHERE contains(text, 'GNU') UNION SELECT doc_id FROM documents WHERE contains(text, 'MIT License') EXCEPT SELECT doc_id FROM labels WHERE quality = 0""")
def authority_union(spark, d):
    docs = table(spark, d, "documents")
    by_name = docs.filter(F.contains("text", F.lit("GNU"))).select("doc_id")
    by_use = docs.filter(F.contains("text", F.lit("MIT License"))).select("doc_id")
    return by_name.union(by_use).distinct().join(table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id, sha256(regexp_replace(text, '\\bthe\\b', 'THE', 'g')) AS all_replaced, sha256(CASE WHEN instr(text, 'the') > 0 THEN left(text, CAST(instr(text, 'the') AS BIGINT) - 1) || 'THE' || substr(text, CAST(instr(text, 'the') AS BIGINT) + 3) ELSE text END) AS first_replaced, contains(text, 'the') AS changed FROM documents""")
def patch_replace(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.sha2(F.regexp_replace("text", r"\bthe\b", "THE"), 256).alias("all_replaced"), F.sha2(T.replace_first(F.col("text"), "the", "THE"), 256).alias("first_replaced"), F.contains("text", F.lit("the")).alias("changed"))


@query("""SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT lang) AS n FROM documents GROUP BY source""")
def family_labels(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.countDistinct("lang").alias("n"))


@query("""SELECT doc_id, replace(source || '_' || lang, '_', '-') || '-' || CASE WHEN n_chars < 500 THEN 'small' ELSE 'large' END AS sample_id, split_part(source || '_' || lang, '_', 1) AS family FROM documents""")
def sample_ids(spark, d):
    rows = table(spark, d, "documents").withColumn("file", F.concat_ws("_", "source", "lang"))
    return rows.select("doc_id", T.sample_id(F.concat("file", F.lit(".sol")), F.when(F.col("n_chars") < 500, "small").otherwise("large")).alias("sample_id"), T.family_of(F.col("file")).alias("family"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, contains(lower(event_type), 'err') AS named FROM events""")
def utc_stamps(spark, d):
    return table(spark, d, "events").select("event_id", T.utc_stamp(F.col("ts")).alias("stamp"), T.name_contains(F.col("event_type"), "err").alias("named"))


@query("""WITH c AS (SELECT conv_id, string_agg(role || ': ' || replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10) ORDER BY turn, role, text) AS source FROM conversations GROUP BY conv_id)
SELECT (conv_id % 100)::VARCHAR || '/' || conv_id || '.txt' AS file, strlen(source)::BIGINT AS byte_length, sha256(source) AS sha256, 'ok' AS status FROM c""")
def source_tree_round_trip(spark, d):
    """Every conversation as a file of a tree, written and read again by the data source of trees."""
    source_tree.register(spark)
    folder = f"{source_tree.local_path(shared_folder(spark))}/tree-{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    line = lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), line), "\n").alias("source"))
    named = files.select(F.concat((F.col("conv_id") % 100).cast("string"), F.lit("/"), F.col("conv_id"), F.lit(".txt")).alias("file"), "source")
    named.write.format("source_tree").mode("append").save(folder)
    # Tasks write into folders of their own, which are not part of the names that were given.
    read = spark.read.format("source_tree").option("pattern", "*.txt").load(folder)
    return read.select(F.substring_index("file", "/", -2).alias("file"), "byte_length", "sha256", "status")
