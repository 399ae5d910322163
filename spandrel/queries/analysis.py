"""The analysis pipeline over the bundled samples, and flattening of nested values.

The SQL of these queries holds what the samples are expected to give: it is written from
their sources by hand (``sources.samples`` and the fixed values below), or counts words
in the sources, and runs none of the analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.report import RULES
from ..operators.rounds import written
from ..plans import ast, features, ml, patch, programs, rules
from ..sources.inputs import compile_sources
from ..sources.minisol import compile_source
from ..sources.samples import SAMPLES
from .common import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: What is expected at which line: sample, rule, function, line.
_FOUND = [
    ("origin_guard", "TXO", "f", 3), ("origin_revert", "TXO", "f", 3), ("origin_two_guards", "TXO", "f", 3), ("origin_two_guards", "TXO", "f", 4), ("origin_two_effects", "TXO", "f", 3),
    ("check_call_write", "REN", "f", 4), ("check_by_local", "REN", "f", 5), ("hex_key", "REN", "f", 4), ("stale_local", "UEC", "f", 6),
    ("owner_replaced", "ACC", "f", 3), ("owner_replaced_under_flag", "ACC", "f", 3), ("new_owner_untrusted", "ACC", "f", 3), ("new_owner_untrusted", "ACC", "f", 5), ("authority_by_use", "ACC", "f", 7),
    ("call_dropped", "UEC", "f", 3), ("call_failure_empty", "UEC", "f", 3), ("call_overwritten", "UEC", "f", 4), ("delegatecall_dropped", "UEC", "f", 3),
    ("exact_time", "TMP", "f", 3), ("exact_now", "TMP", "f", 3), ("time_remainder", "TMP", "f", 3),
    ("several", "ACC", "a", 3), ("several", "REN", "e", 14), ("several", "TXO", "d", 9), ("several", "UEC", "c", 6),
]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FOUND_SQL = "found AS (SELECT name || '_0.sol' AS file, rule || '-001' AS rule_id, function, line FROM (VALUES " + ", ".join(f"('{n}', '{r}', '{f}', {k})" for n, r, f, k in _FOUND) + ") t(name, rule, function, line))"
_SAMPLES_SQL = "samples AS (SELECT name || '_0.sol' AS file, source, undecided FROM (VALUES " + ", ".join(f"('{n}', {_text(s)}, '{u}')" for n, (s, _, u) in SAMPLES.items()) + ") t(name, source, undecided))"
_RULES_SQL = "rules AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in RULES) + "]) AS rule_id)"
#: A dropped delegatecall is as severe as the rules on authority and state; a time is not, nor another dropped call.
_SEVERITY = "CASE WHEN rule_id LIKE 'TMP%' OR (rule_id LIKE 'UEC%' AND file NOT LIKE 'delegatecall%') THEN 'medium' ELSE 'high' END"


def sample_files(spark: SparkSession, copies: int = 1) -> DataFrame:
    """``(file, source, output)`` of every sample, ``copies`` times under different names."""
    rows = spark.createDataFrame([(name, source) for name, (source, _, _) in SAMPLES.items()], "name string, source string")
    many = rows.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(F.concat_ws("_", "name", F.col("id").cast("string")).alias("file"), "source").repartition(spark.sparkContext.defaultParallelism)
    return compile_sources(many.withColumn("file", F.concat("file", F.lit(".sol"))), compile_source)


def _reports(spark: SparkSession) -> DataFrame:
    return rules.analyze(sample_files(spark))


@query(f"WITH {_FOUND_SQL} SELECT file, rule_id, {_SEVERITY} AS severity, CASE WHEN rule_id LIKE 'REN%' THEN 'medium' ELSE 'high' END AS confidence, function, line, line AS end_line FROM found")
def rule_scan(spark, d):
    return rules.findings(_reports(spark)).select("file", "rule_id", "severity", "confidence", "function", "line", "end_line")


@query(f"WITH {_SAMPLES_SQL}, {_RULES_SQL} SELECT file, rule_id, CASE WHEN contains(undecided, left(rule_id, 3)) THEN 'unsupported' ELSE 'completed' END AS status, contains(undecided, left(rule_id, 3)) AS has_reasons FROM samples, rules")
def rule_results(spark, d):
    return rules.results(_reports(spark)).select("file", "rule_id", "status", (F.size("reasons") > 0).alias("has_reasons"))


@query(f"""WITH {_FOUND_SQL}, {_RULES_SQL}, s AS (SELECT unnest(['high', 'medium', 'low']) AS severity)
SELECT rules.rule_id, s.severity, CAST(count(f.file) AS BIGINT) AS n FROM rules CROSS JOIN s LEFT JOIN (SELECT *, {_SEVERITY} AS severity FROM found) f ON f.rule_id = rules.rule_id AND f.severity = s.severity GROUP BY ALL""")
def report_summary(spark, d):
    return rules.summary(_reports(spark)).groupBy("rule_id", "severity").agg(F.sum("n").alias("n"))


#: Kinds of nodes that one keyword or mark in a source makes each.
_WORDS = {
    "ContractDefinition": r"\b(contract|interface) [A-Z]", "FunctionDefinition": r"\bfunction ", "ModifierDefinition": r"\bmodifier ", "EventDefinition": r"\bevent ", "IfStatement": r"\bif ",
    "WhileStatement": r"\bwhile ", "Return": r"\breturn ", "EmitStatement": r"\bemit ", "PlaceholderStatement": r"_; ", "SourceUnit": r"^",
}


@query(f"WITH {_SAMPLES_SQL} SELECT node_type, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS node_type, len(regexp_extract_all(source, '{w}')) AS n FROM samples" for k, w in _WORDS.items()) + ") GROUP BY node_type")
def ast_nodes(spark, d):
    return ast.flatten(sample_files(spark)).filter(F.col("node_type").isin(*_WORDS)).groupBy("node_type").agg(F.count("*").alias("n"))


@query()
def feature_rows(spark, d):
    rows = features.long(ast.flatten(sample_files(spark)))
    return rows.select("file", "rule_id", F.explode("features").alias("feature", "value")).filter("value <> 0")


#: Features that words in the functions of a source tell, by rule and name, and whether they are counted or only seen.
_COUNTED = {
    ("TXO-001", "origin_guard_count"): (r"tx\.origin (==|!=)|(==|!=) tx\.origin", True), ("TXO-001", "has_origin_comparison"): (r"tx\.origin (==|!=)|(==|!=) tx\.origin", False),
    ("TXO-001", "branch_count"): (r"\bif ", True), ("TXO-001", "sender_auth_present"): (r"msg\.sender", False),
    ("UEC-001", "low_level_call_count"): (r"\.(call|delegatecall|staticcall)\(", True), ("UEC-001", "delegatecall_count"): (r"\.delegatecall\(", True),
    ("TMP-001", "has_timestamp_reference"): (r"block\.timestamp|\bnow\b", False), ("TMP-001", "timestamp_equality_guard"): (r"(block\.timestamp|\bnow) (==|!=)", False),
    ("TMP-001", "timestamp_modulo_arithmetic"): (r"block\.timestamp %", False), ("TMP-001", "interval_comparison_present"): (r"block\.timestamp (>=|<=|>|<)", False),
    ("ACC-001", "public_entry_point_count"): (r"function [^{};]*\b(public|external)\b", True), ("ACC-001", "caller_restriction_present"): (r"msg\.sender (==|!=)", False),
    ("REN-001", "unsupported_feature"): (r"\bwhile ", False),
}
_COUNTS_SQL = " UNION ALL ".join(f"SELECT file, '{r}' AS rule_id, '{f}' AS feature, {'' if counted else 'least(1, '}len(regexp_extract_all(body, '{w}')){'' if counted else ')'} AS value FROM b" for (r, f), (w, counted) in _COUNTED.items())


@query(rf"WITH {_SAMPLES_SQL}, b AS (SELECT file, regexp_replace(split_part(source, chr(10) || 'contract C', 1), 'modifier [^\n]*', '') AS body FROM samples) SELECT file, rule_id, feature, CAST(value AS DOUBLE) AS value FROM ({_COUNTS_SQL}) WHERE value > 0")
def feature_counts(spark, d):
    """Those features of the samples that words in the functions of their first contract tell."""
    rows = features.long(ast.flatten(sample_files(spark)))
    named = F.concat_ws(".", "rule_id", "feature").isin(*(f"{r}.{f}" for r, f in _COUNTED))
    return rows.select("file", "rule_id", F.explode("features").alias("feature", "value")).filter(named & (F.col("value") > 0))


#: Statements of functions that one keyword each makes; a modifier's checks are statements of each function that it guards.
_STATEMENTS = {"guard": r"\b(require|assert)\(", "branch": r"\bif ", "emit": r"\bemit ", "return": r"\breturn ", "unsupported": r"\bwhile "}


def _graphs(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = programs.programs(sample_files(spark))
    return programs.nodes(made), programs.edges(made), programs.effects(made)


@query(f"WITH {_SAMPLES_SQL} SELECT file, kind, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT file, '{k}' AS kind, len(regexp_extract_all(source, '{w}')) - CASE WHEN '{k}' = 'branch' AND contains(source, 'modifier m()') THEN 1 ELSE 0 END AS n FROM samples" for k, w in _STATEMENTS.items()) + ") WHERE n > 0")
def cfg_nodes(spark, d):
    nodes, _, _ = _graphs(spark)
    return nodes.filter(F.col("kind").isin(*_STATEMENTS)).groupBy("file", "kind").agg(F.count("*").alias("n"))


#: The edges of three samples' function f, by the kinds of their ends.
_EDGES = {
    "call_failure_handled": [("entry", "normal", "block"), ("block", "normal", "declaration"), ("declaration", "normal", "branch"), ("branch", "true", "block"), ("block", "normal", "expression"), ("expression", "normal", "exit"), ("branch", "false", "exit")],
    "terminated": [("entry", "normal", "block"), ("block", "normal", "expression"), ("expression", "normal", "revert"), ("revert", "exceptional", "failure")],
    "constant_guard": [("entry", "normal", "block"), ("block", "normal", "guard"), ("guard", "false", "failure"), ("expression", "normal", "exit")],
}


@query("SELECT name || '_0.sol#C.f' AS graph, src, kind, dst, CAST(count(*) AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{k}', '{b}')" for n, es in _EDGES.items() for a, k, b in es) + ") t(name, src, kind, dst) GROUP BY ALL")
def cfg_edges(spark, d):
    nodes, edges, _ = _graphs(spark)
    ends = lambda end: nodes.select("graph", F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"))
    named = edges.filter(F.col("graph").isin(*(f"{n}_0.sol#C.f" for n in _EDGES))).join(ends("src"), ["graph", "src"]).join(ends("dst"), ["graph", "dst"])
    return named.groupBy("graph", F.col("src_kind").alias("src"), "kind", F.col("dst_kind").alias("dst")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_SAMPLES_SQL}, bodies AS (SELECT file, unnest(regexp_extract_all(regexp_replace(source, 'modifier only\(\).*\n', ''), 'function [^;{{]*\{{[^\n]*\n?(?: [^\n]*\n)*')) AS body, contains(source, 'public only') AS guarded FROM samples),
f AS (SELECT *, contains(body, 'while ') AS loops, regexp_matches(body, 'require\(false\)|;\n revert\(\);') AS stopped, guarded OR regexp_matches(body, 'require\(|assert\(|revert\(') AS fails FROM bodies)
SELECT file, asked, status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT file, 'exit' AS asked, CASE WHEN loops THEN 'unknown' WHEN stopped THEN 'no' ELSE 'yes' END AS status FROM f
  UNION ALL SELECT file, 'failure', CASE WHEN loops THEN 'unknown' WHEN fails THEN 'yes' ELSE 'no' END FROM f
  UNION ALL SELECT file, 'foreign', 'invalid' FROM f) GROUP BY ALL""")
def exit_reachability(spark, d):
    """For every function of the samples: are its normal exit, its exceptional exit, and a node of no graph reached."""
    nodes, edges, _ = _graphs(spark)
    pairs = nodes.filter("entry").select("file", "graph", F.col("id").alias("src"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("exit", "failure", "foreign"))), F.array(*(F.lit(k).cast("long") for k in (-1, -2, -9))))).alias("asked", "dst"))
    answers = G.reachable(pairs.select("graph", "src", "dst"), edges, nodes)
    return pairs.join(answers, ["graph", "src", "dst"]).groupBy("file", "asked", "status").agg(F.count("*").alias("n"))


@query("""SELECT file, first, second, status FROM (VALUES ('check_call_write_0.sol', 'low_level', 'write', 'yes'), ('check_call_write_0.sol', 'write', 'low_level', 'no'), ('write_first_0.sol', 'low_level', 'write', 'no'), ('write_first_0.sol', 'write', 'low_level', 'yes'),
('increment_0.sol', 'read', 'write', 'unknown'), ('increment_0.sol', 'write', 'read', 'unknown'), ('owner_replaced_0.sol', 'write', 'write', 'no'), ('owner_replaced_0.sol', 'write', 'none', 'invalid')) t(file, first, second, status)""")
def effect_order(spark, d):
    """Can one effect come before another, for effects named by their kind in four samples."""
    nodes, edges, effects = _graphs(spark)
    asked = [("check_call_write", "low_level", "write"), ("check_call_write", "write", "low_level"), ("write_first", "low_level", "write"), ("write_first", "write", "low_level"), ("increment", "read", "write"), ("increment", "write", "read"), ("owner_replaced", "write", "write"), ("owner_replaced", "write", "none")]
    rows = spark.createDataFrame([(f"{n}_0.sol", a, b) for n, a, b in asked], "file string, first_kind string, second_kind string")
    one = lambda end: effects.groupBy("file", "graph", F.col("kind").alias(f"{end}_kind")).agg(F.min("id").alias(end))
    pairs = rows.join(one("first"), ["file", "first_kind"]).join(one("second").drop("graph"), ["file", "second_kind"], "left").withColumn("second", F.coalesce("second", F.lit(-9)))
    answers = G.ordered_effects(pairs.select("graph", "first", "second"), effects, edges, nodes)
    return pairs.join(answers, ["graph", "first", "second"]).select("file", F.col("first_kind").alias("first"), F.col("second_kind").alias("second"), "status")


#: Lines that the patches of some samples take away and add.
_CHANGES = [
    ("origin_guard", "TXO", [" require(tx.origin == owner);"], [" require(msg.sender == owner);"]), ("origin_revert", "TXO", [" if (tx.origin != owner) revert();"], [" if (msg.sender != owner) revert();"]),
    ("check_call_write", "REN", [" b[1] = 0;"], [" b[1] = 0;"]), ("hex_key", "REN", [" b[0x01] = 0;"], [" b[0x01] = 0;"]),
    ("owner_replaced", "ACC", [], [' require(msg.sender == owner, "unauthorized");']), ("authority_by_use", "ACC", [], [' require(msg.sender == boss, "unauthorized");']),
    ("call_dropped", "UEC", [' t.call("");'], [' (bool success, ) = t.call("");', ' require(success, "call failed");']), ("call_overwritten", "UEC", [], [' require(ok, "call failed");']),
    ("exact_time", "TMP", [" require(block.timestamp == deadline);"], [" require(block.timestamp >= deadline);"]), ("exact_now", "TMP", [" if (now != deadline) revert();"], [" if (now < deadline) revert();"]),
]


@query("SELECT name || '_0.sol' AS file, rule || '-001' AS rule_id, taken, added FROM (VALUES " + ", ".join("(" + ", ".join((_text(n), _text(r), _text(chr(10).join(a)), _text(chr(10).join(b)))) + ")" for n, r, a, b in _CHANGES) + ") t(name, rule, taken, added)")
def unified_diff(spark, d):
    files = sample_files(spark)
    made = patch.propose(patch.candidates(files, rules.analyze(files)))
    lines = lambda sign: F.array_join(F.transform(F.filter(F.slice(F.split("diff", "\n"), 3, 1000), lambda x: F.startswith(x, F.lit(sign))), lambda x: F.substr(x, F.lit(2))), "\n")
    return made.filter(F.col("file").isin(*(f"{n}_0.sol" for n, *_ in _CHANGES))).select("file", "rule_id", lines("-").alias("taken"), lines("+").alias("added"))


@query(f"""WITH {_FOUND_SQL}, t AS (SELECT file, CAST(count(*) AS INT) AS before FROM found GROUP BY file)
SELECT file, rule_id, CASE WHEN file LIKE 'origin_two_guards%' THEN 'unverified' ELSE 'verified' END AS status, before, CASE WHEN file LIKE 'new_owner%' THEN 0 ELSE before - 1 END AS remaining, false AS regressed FROM found JOIN t USING (file)""")
def patch_verification(spark, d):
    """One of two like guards is left in origin_two_guards; one check at the entry guards both writes of new_owner_untrusted."""
    files = sample_files(spark)
    return patch.verify(patch.propose(patch.candidates(files, rules.analyze(files))), compile_source).select("file", "rule_id", "status", "before", "remaining", "regressed")


@query()
def ml_scores(spark, d):
    files = written(sample_files(spark))
    labels = spark.createDataFrame([(f"{name}_0.sol", rule, int(rule[:3] in found)) for name, (_, found, _) in SAMPLES.items() for rule in RULES], "file string, rule_id string, label int")
    parts = labels.select("file").distinct().withColumn("part", F.when(F.pmod(F.xxhash64("file"), F.lit(3)) == 0, "validation").otherwise("train"))
    rows = written(features.long(written(ast.flatten(files))))
    models = ml.train(rows, labels, parts)
    return ml.score(rows, models, rules.findings(rules.analyze(files))).select("file", "rule_id", "probability", "prediction", "confidence", "deterministic", "concordant", "advisory", "hybrid")


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
