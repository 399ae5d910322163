"""Metrics, fusion and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import report as R
from ..plans import newton
from .common import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")


_TOXIC = "(contains(text, 'idiot') OR contains(text, 'pathetic'))"
_RATES = """
  round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 1 END, 4) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 1 END, 4) AS specificity,
  round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END, 4) AS fpr,
  round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END, 4) AS fnr"""
_COUNTS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn"
_LABELLED = f"SELECT lang, source, quality, toxic AS y, CAST({_TOXIC} AS INT) AS p, text, n_chars, doc_id FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT lang, tp, fp, tn, fn, {_RATES} FROM (SELECT lang, {_COUNTS} FROM ({_LABELLED}) GROUP BY lang)")
def confusion_metrics(spark, d):
    rows = _labelled(spark, d).select("lang", F.col("toxic").alias("y"), F.expr(f"CAST({_TOXIC} AS INT)").alias("p"))
    return M.rates(M.confusion(rows, ["lang"]))


@query(f"""SELECT source, lang, tp, fp, tn, fn,
  CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) END AS precision,
  CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 4) END AS recall,
  CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE round(2 * tp / (2 * tp + fp + fn), 4) END AS f1
FROM (SELECT source, lang, {_COUNTS} FROM ({_LABELLED}) GROUP BY source, lang)""")
def single_class_metrics(spark, d):
    rows = _labelled(spark, d).select("source", "lang", F.col("toxic").alias("y"), F.expr(f"CAST({_TOXIC} AS INT)").alias("p"))
    return M.rates_single_class(M.confusion(rows, ["source", "lang"])).drop("accuracy", "specificity", "fpr", "fnr")


@query("SELECT lang, round(avg(pow(least(1.0, n_chars / 8000.0) - quality, 2)), 4) AS brier, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def brier_score(spark, d):
    rows = _labelled(spark, d).select("lang", F.col("quality").alias("y"), F.expr("least(1.0D, n_chars / 8000.0D)").alias("p"))
    return M.brier(rows, ["lang"])


_TWO = "CAST(contains(text, '%%%') AS INT) AS det, CAST(n_chars < 600 AS INT) AS ml"
_FUSED = f"SELECT d.doc_id, d.lang, coalesce(1 - l.quality, 0) AS y, {_TWO} FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"""SELECT lang, count(*) FILTER (greatest(det, ml) = 1) AS n_flagged, count(*) FILTER (det = ml) AS n_concordant, count(*) FILTER (ml = 1 AND det = 0) AS n_advisory,
  count(*) FILTER (y = 1 AND greatest(det, ml) = 1) AS n_hit, count(*) AS n FROM ({_FUSED}) GROUP BY lang""")
def hybrid_fusion(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").select("lang", F.coalesce(1 - F.col("quality"), F.lit(0)).alias("y"), F.contains("text", F.lit("%%%")).cast("int").alias("det"), (F.col("n_chars") < 600).cast("int").alias("ml"))
    either = F.greatest("det", "ml")
    return rows.groupBy("lang").agg(
        F.count_if(either == 1).alias("n_flagged"), F.count_if(F.col("det") == F.col("ml")).alias("n_concordant"), F.count_if((F.col("ml") == 1) & (F.col("det") == 0)).alias("n_advisory"),
        F.count_if((F.col("y") == 1) & (either == 1)).alias("n_hit"), F.count("*").alias("n"),
    )


@query(f"""SELECT lang, modality, tp, fp, tn, fn, {_RATES} FROM (
  SELECT lang, modality, {_COUNTS} FROM (SELECT lang, y, 'deterministic' AS modality, det AS p FROM ({_FUSED}) UNION ALL SELECT lang, y, 'model', ml FROM ({_FUSED}) UNION ALL SELECT lang, y, 'hybrid', greatest(det, ml) FROM ({_FUSED}))
  GROUP BY lang, modality)""")
def modality_matrix(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").select("lang", F.coalesce(1 - F.col("quality"), F.lit(0)).alias("y"), F.contains("text", F.lit("%%%")).cast("int").alias("det"), (F.col("n_chars") < 600).cast("int").alias("ml"))
    return M.modalities(rows, "y", {"deterministic": F.col("det"), "model": F.col("ml"), "hybrid": F.greatest("det", "ml")}, ["lang"])


@query(f"""SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, count(*) AS n_groups
FROM (SELECT {_RATES} FROM (SELECT lang, {_COUNTS} FROM ({_LABELLED}) GROUP BY lang))""")
def macro_average(spark, d):
    return M.macro_average(confusion_metrics(spark, d), ["precision", "recall", "f1"])


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS most,
  round(coalesce(stddev_samp(value), 0), 4) AS sd, round(quantile_disc(value, 0.95), 4) AS p95, round(quantile_disc(value, 0.99), 4) AS p99, round(1.0 / nullif(avg(value), 0), 4) AS per_unit
FROM events GROUP BY event_type""")
def latency_profile(spark, d):
    return M.latency_profile(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT event_type, count(value) AS n, round(count(value) / sum(value), 2) AS runs_per_s, round(sum(length(props)) / sum(value), 2) AS loc_per_s, round(sum(length(props)) / (sum(value) * 1000), 5) AS kloc_per_s
FROM events GROUP BY event_type""")
def throughput_rates(spark, d):
    rows = table(spark, d, "events").withColumn("lines", F.length("props"))
    return M.throughput(rows, ["event_type"], "value", "lines")


_P = "CAST(event_id % 101 AS DOUBLE) / 100"


@query(f"""SELECT confidence, count(*) FILTER ((p >= 0.5) = (event_type = 'purchase')) AS n_same, count(*) AS n,
  round(count(*) FILTER ((p >= 0.5) = (event_type = 'purchase')) / greatest(count(*), 1), 4) AS rate
FROM (SELECT event_type, p, CASE WHEN p >= 0.85 OR p <= 0.15 THEN 'high' WHEN p >= 0.65 OR p <= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT event_type, {_P} AS p FROM events))
GROUP BY confidence""")
def concordance_rate(spark, d):
    rows = table(spark, d, "events").select("event_type", F.expr(_P).alias("p")).withColumn("confidence", T.confidence_bucket(F.col("p")))
    return M.concordance(rows.withColumn("same", (F.col("p") >= 0.5) == (F.col("event_type") == "purchase")), ["confidence"], "same")


@query("""WITH types(event_type) AS (VALUES ('click'), ('purchase'), ('error'), ('signup'), ('view'), ('refund'))
SELECT event_type, coalesce(n, 0) AS n, coalesce(n_users, 0) AS n_users FROM types LEFT JOIN (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type) USING (event_type)""")
def rule_summary_zero_fill(spark, d):
    domain = spark.createDataFrame([(x,) for x in ("click", "purchase", "error", "signup", "view", "refund")], "event_type string")
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
    return R.zero_filled(domain, counts, ["event_type"]).withColumn("n_users", F.coalesce("n_users", F.lit(0)))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY seen_at) AS evidence FROM (SELECT user_id, event_type, min(event_id) AS seen_at FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def finding_dedup(spark, d):
    rows = R.dedup_findings(table(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return rows.select("user_id", F.array_join("event_type", ",").alias("evidence"))


_REASON = "CASE WHEN contains(text, '%%%') THEN 'symbols' WHEN n_chars < 300 THEN 'short' END"


@query(f"""SELECT source, CASE WHEN bool_or(reason IS NOT NULL) THEN 'partial' ELSE 'completed' END AS status, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons
FROM (SELECT source, {_REASON} AS reason FROM documents) GROUP BY source""")
def coverage_status(spark, d):
    rows = R.coverage(table(spark, d, "documents").select("source", F.expr(_REASON).alias("reason")), ["source"], "reason")
    return rows.withColumn("reasons", F.array_join("reasons", ","))


_PART = "CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'validation' WHEN 1 THEN 'locked_test' WHEN 2 THEN 'excluded' ELSE 'train' END"


@query(f"""SELECT family, string_agg(DISTINCT part, ',' ORDER BY part) AS partitions FROM (SELECT source || '-' || lang || '-' || CAST(n_chars % 50 AS VARCHAR) AS family, {_PART} AS part FROM documents)
WHERE part <> 'excluded' GROUP BY family HAVING count(DISTINCT part) > 1""")
def family_leakage(spark, d):
    rows = table(spark, d, "documents").select(F.concat_ws("-", "source", "lang", (F.col("n_chars") % 50).cast("string")).alias("family"), F.expr(_PART).alias("part"))
    return Q.family_leakage(rows, "family", "part").withColumn("partitions", F.array_join("partitions", ","))


@query("""WITH RECURSIVE x AS (SELECT lang, quality::DOUBLE AS y, ln(1 + n_chars)::DOUBLE AS v FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND quality IN (0, 1) AND n_chars IS NOT NULL),
r(lang, step, b0, b1) AS (SELECT DISTINCT lang, 0, 0::DOUBLE, 0::DOUBLE FROM x UNION ALL
  SELECT lang, step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT lang, step, b0, b1, sum(y - p) - b0 AS g0, sum((y - p) * v) - b1 AS g1, sum(p * (1 - p)) + 1 AS h00, sum(p * (1 - p) * v) AS h01, sum(p * (1 - p) * v * v) + 1 AS h11
    FROM (SELECT r.*, y, v, 1 / (1 + exp(-(b0 + b1 * v))) AS p FROM r JOIN x USING (lang) WHERE step < 25) GROUP BY lang, step, b0, b1))
SELECT r.lang, count(*) AS n, round(b0, 4) AS intercept, round(b1, 4) AS slope, true AS converged FROM r JOIN x USING (lang) WHERE step = 25 GROUP BY r.lang, b0, b1""")
def grouped_logistic(spark, d):
    """Quality by the logarithm of a text's length, fitted for all languages at once."""
    rows = _labelled(spark, d).select("lang", "quality", F.log(1 + F.col("n_chars")).alias("v"))
    found = newton.fit(rows, "lang", "quality", ["v"])
    return found.select("lang", "n", F.round(F.col("coefficients")[0], 4).alias("intercept"), F.round(F.col("coefficients")[1], 4).alias("slope"), "converged")


@query(f"""SELECT part_a, part_b, count(*) AS n_shared FROM (SELECT DISTINCT source, lang, {_PART} AS part_a FROM documents) a JOIN (SELECT DISTINCT source, lang, {_PART} AS part_b FROM documents) b USING (source, lang)
WHERE part_a < part_b GROUP BY part_a, part_b""")
def partition_overlap(spark, d):
    parts = table(spark, d, "documents").select("source", "lang", F.expr(_PART).alias("part")).distinct()
    both = parts.withColumnRenamed("part", "part_a").join(parts.withColumnRenamed("part", "part_b"), ["source", "lang"]).filter("part_a < part_b")
    return both.groupBy("part_a", "part_b").agg(F.count("*").alias("n_shared"))


@query("""WITH r AS (SELECT d.doc_id, lang, source, n_chars, text, quality FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, 'no label' AS problem FROM r WHERE quality IS NULL UNION ALL SELECT doc_id, 'language' FROM r WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT doc_id, 'length' FROM r WHERE n_chars <> length(text)
UNION ALL SELECT doc_id, 'short' FROM r WHERE n_chars < 100 UNION ALL SELECT doc_id, 'duplicate id' FROM r GROUP BY doc_id HAVING count(*) > 1""")
def annotation_validation(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    own = Q.violations(rows, "doc_id", {"no label": F.col("quality").isNull(), "language": ~F.col("lang").isin("en", "fr", "de"), "length": F.col("n_chars") != F.length("text"), "short": F.col("n_chars") < 100})
    return own.unionByName(Q.duplicates(rows, "doc_id").withColumn("problem", F.lit("duplicate id")))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, count(l_orderkey) AS n, count(DISTINCT l_linenumber) AS d, coalesce(sum(l_quantity), 0) AS q FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderkey, 'no lines' AS problem FROM s WHERE n = 0 UNION ALL SELECT o_orderkey, 'duplicate line' FROM s WHERE n <> d UNION ALL SELECT o_orderkey, 'large' FROM s WHERE q > 250""")
def report_invariants(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    per_line = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.count("*").alias("k"), F.sum("l_quantity").alias("q"))
    sums = per_line.groupBy("o_orderkey").agg(F.sum("k").alias("n"), F.count("l_linenumber").alias("d"), F.sum("q").alias("q"))
    rows = table(spark, d, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").fillna(0, ["n", "d", "q"])
    return Q.violations(rows, "o_orderkey", {"no lines": F.col("n") == 0, "duplicate line": F.col("n") != F.col("d"), "large": F.col("q") > 250})


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right only' ELSE 'left only' END AS side
FROM (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 500) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def manifest_orphans(spark, d):
    return Q.orphans(table(spark, d, "documents").filter("n_chars > 500"), table(spark, d, "labels"), "doc_id")


@query("SELECT lang, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS high FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_pivot(spark, d):
    return _labelled(spark, d).groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("quality") == 1).alias("high"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang = 'en' AND source = 'src0' GROUP BY lang, source")
def filter_conjunction(spark, d):
    return Q.conjunction(table(spark, d, "documents"), lang="en", source="src0", text=None).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang, source FROM documents ORDER BY lang, source")
def filter_options(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@query("""WITH c AS (SELECT lang, source, count(*) AS n, round(count(*) FILTER (contains(text, '%%%')) / count(*), 4) AS score, CAST(substr(source, 4) AS INT) AS position FROM documents GROUP BY lang, source)
SELECT lang, source, n, score, position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source = 'src0', position) AS rn FROM c) WHERE rn = 1""")
def model_select(spark, d):
    rows = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.count_if(F.contains("text", F.lit("%%%"))) / F.count("*"), 4).alias("score"))
    rows = rows.withColumns({"position": F.substring("source", 4, 9).cast("int"), "_dummy": F.col("source") == "src0"})
    return M.argmax_first(rows, ["lang"], "score", "position", "_dummy").select("lang", "source", "n", "score", "position")


@query("SELECT r_name, p_type, count(*) AS n FROM region, (SELECT DISTINCT split_part(p_type, ' ', 1) AS p_type, p_partkey FROM part) GROUP BY r_name, p_type")
def rule_file_grid(spark, d):
    rules = table(spark, d, "region").select("r_name")
    parts = table(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("p_type")).agg(F.countDistinct("p_partkey").alias("n"))
    # The grid of a fixed handful of rules and already aggregated categories.
    return rules.crossJoin(F.broadcast(parts)).select("r_name", "p_type", "n")


@query("""SELECT count(*) AS n, round(avg(CAST(l_returnflag = 'N' AS INT)), 4) AS eliminated, round(avg(CAST(l_linestatus = 'F' AS INT)), 4) AS reverified, round(avg(CAST(l_discount = 0 OR l_tax < 0.02 AS INT)), 4) AS zero_regression, l_linenumber FROM lineitem GROUP BY l_linenumber""")
def remediation_rates(spark, d):
    flag = lambda c: F.round(F.avg(F.expr(c).cast("int")), 4)
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), flag("l_returnflag = 'N'").alias("eliminated"), flag("l_linestatus = 'F'").alias("reverified"), flag("l_discount = 0 OR l_tax < 0.02").alias("zero_regression"))


_RULE = "CASE lang WHEN 'en' THEN 'TXO-001' WHEN 'fr' THEN 'REN-001' WHEN 'de' THEN 'UEC-001' ELSE 'other' END"
_ANNOTATION = f"""CASE WHEN doc_id % 50 = 7 THEN ' ' WHEN doc_id % 97 = 5 THEN concat('d', CAST(doc_id - 1 AS STRING)) ELSE concat('d', CAST(doc_id AS STRING)) END AS sample_id, {_RULE} AS rule_id,
CASE WHEN toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'present' WHEN quality = 0 THEN 'absent' ELSE 'unknown' END AS label, CASE WHEN n_chars % 11 = 0 THEN source ELSE sha256 END AS sha256, doc_id % 3 <> 0 AS reviewed"""


@query(f"""WITH d AS (SELECT d.*, quality, toxic, sha256(text) AS sha256 FROM documents d LEFT JOIN labels USING (doc_id)), r AS (SELECT {_ANNOTATION} FROM d)
SELECT sample_id, 'empty id' AS problem FROM r WHERE trim(sample_id) = '' UNION ALL SELECT sample_id, 'rule' FROM r WHERE rule_id = 'other' UNION ALL SELECT sample_id, 'label' FROM r WHERE label = 'maybe'
UNION ALL SELECT sample_id, 'hash' FROM r WHERE coalesce(NOT regexp_full_match(sha256, '[0-9a-f]{{64}}'), true) UNION ALL SELECT sample_id, 'not reviewed' FROM r WHERE label IN ('present', 'absent') AND NOT reviewed
UNION ALL SELECT sample_id, 'duplicate id' FROM r GROUP BY sample_id HAVING count(*) > 1""")
def annotation_rules(spark, d):
    """Documents and labels as annotation rows, some of them broken, through the validation of annotations."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha256")).join(table(spark, d, "labels"), "doc_id", "left")
    return Q.validate_annotations(docs.selectExpr(*_top_level(_ANNOTATION)))


def _top_level(columns: str) -> list[str]:
    """The expressions of a select list, which both dialects read."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query("""WITH d AS (SELECT doc_id AS file, string_split(text, chr(10)) AS l, strlen(text) AS b FROM documents WHERE text IS NOT NULL),
r AS (SELECT file, CASE file % 4 WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, len(l) + CASE WHEN file % 13 = 0 THEN 1 ELSE 0 END AS total, b FROM d),
f AS (SELECT file, CASE WHEN file % 17 = 0 THEN i % 7 ELSE i END AS id, 40 * i AS o, strlen(s) AS n FROM (SELECT file, unnest(l) AS s, unnest(range(len(l))) AS i FROM d)),
q AS (SELECT file, unnest(['TXO-001', 'REN-001', 'ACC-001', 'UEC-001', 'TMP-001']) AS rule_id FROM d), x AS (SELECT file, rule_id, CASE WHEN (file % 4 = 1 OR file % 29 = 0) AND rule_id = 'ACC-001' THEN 'unsupported' ELSE 'checked' END AS status, CASE WHEN file % 4 = 1 AND rule_id = 'ACC-001' AND file % 31 <> 0 THEN 1 ELSE 0 END AS reasons FROM q WHERE NOT (file % 23 = 0 AND rule_id = 'TMP-001'))
SELECT file, 'rules' AS problem FROM d WHERE file % 23 = 0 UNION SELECT file, 'duplicate ids' FROM f GROUP BY file HAVING count(*) <> count(DISTINCT id) UNION SELECT file, 'total' FROM r JOIN (SELECT file, count(*) AS n FROM f GROUP BY file) USING (file) WHERE n <> total
UNION SELECT file, 'reasons' FROM x WHERE (status = 'unsupported') <> (reasons > 0) UNION SELECT file, 'status' FROM r JOIN (SELECT file, bool_or(status = 'unsupported') AS p FROM x GROUP BY file) USING (file) WHERE status <> 'failed' AND (status = 'partial') <> p
UNION SELECT file, 'span' FROM f JOIN r USING (file) WHERE o + n > b""")
def report_rules(spark, d):
    """Documents as reports and their lines as findings, some of them broken, through the invariants of reports."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.split("text", "\n", -1).alias("l"), F.octet_length("text").alias("byte_length")).filter("l IS NOT NULL")
    id_ = F.col("file")
    reports = docs.select("file", F.when(id_ % 4 == 1, "partial").when(id_ % 4 == 2, "failed").otherwise("completed").alias("status"), (F.size("l") + (id_ % 13 == 0).cast("int")).alias("total"), "byte_length")
    lines = docs.select("file", F.posexplode("l").alias("i", "s"))
    found = lines.select("file", F.when(id_ % 17 == 0, F.col("i") % 7).otherwise(F.col("i")).cast("string").alias("id"), F.lit(R.RULES[0]).alias("rule_id"), F.lit("high").alias("severity"), (40 * F.col("i")).alias("offset"), F.octet_length("s").alias("length"))
    acc = F.col("rule_id") == "ACC-001"
    results = docs.select("file", F.explode(F.array(*map(F.lit, R.RULES))).alias("rule_id")).filter(~((id_ % 23 == 0) & (F.col("rule_id") == "TMP-001")))
    results = results.select("file", "rule_id", F.when(((id_ % 4 == 1) | (id_ % 29 == 0)) & acc, "unsupported").otherwise("checked").alias("status"), F.when((id_ % 4 == 1) & acc & (id_ % 31 != 0), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return R.invariants(reports, found, results)


@query("""WITH d AS (SELECT doc_id, source, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents),
m AS (SELECT CASE WHEN doc_id % 31 = 0 THEN 'bad' ELSE 'DOC-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') END AS id, CASE WHEN doc_id % 29 = 0 THEN ' ' ELSE source END AS category, 1 + doc_id % 5 AS line, coalesce(l[1 + doc_id % 4], '') AS text, CASE WHEN doc_id % 41 <> 0 THEN l END AS l, doc_id FROM d)
SELECT id, 'id' AS problem FROM m WHERE id = 'bad' UNION ALL SELECT id, 'category' FROM m WHERE trim(category) = '' UNION ALL SELECT id, 'no file' FROM m WHERE l IS NULL UNION ALL SELECT id, 'line' FROM m WHERE line > len(l)
UNION ALL SELECT id, 'stale text' FROM m WHERE l IS NOT NULL AND trim(coalesce(l[line], '')) <> trim(text) UNION ALL SELECT id, 'evidence' FROM m WHERE doc_id % 37 = 0 UNION ALL SELECT id, 'duplicate id' FROM m GROUP BY id HAVING count(*) > 1""")
def manifest_rules(spark, d):
    """Documents as sources and manifest rows about their lines, some of them broken, through the validation of manifests."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    id_ = F.col("doc_id")
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)
    line = (1 + id_ % 5).cast("int")
    rows = docs.select(
        F.when(id_ % 31 == 0, "bad").otherwise(F.concat(F.lit("DOC-"), F.lpad((id_ % 1000).cast("string"), 3, "0"))).alias("id"), id_.alias("file"), F.when(id_ % 29 == 0, " ").otherwise(F.col("source")).alias("category"), line.alias("line"),
        F.coalesce(F.try_element_at(lines, (1 + id_ % 4).cast("int")), F.lit("")).alias("text"), F.array(line, line + 1).alias("evidence"), F.array(F.when(id_ % 37 == 0, line + 5).otherwise(line)).alias("expected"),
    )
    return Q.validate_manifest(rows, docs.filter("doc_id % 41 <> 0").select(id_.alias("file"), F.col("text").alias("source")))
