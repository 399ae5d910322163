"""Every registered query of the core against its SQL, and the parts of the analysis that need Spark."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from spandrel import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", core.oracles())
def test_equals_sql(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.sql(core.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in core.queries() if n not in core.oracles() and n != "ml_scores"])
def test_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_remediation_reaches_an_end(spark):
    from spandrel.plans import patch
    from spandrel.queries.analysis import sample_files
    from spandrel.sources.minisol import compile_source

    files = sample_files(spark).filter("file IN ('owner_replaced_0.sol', 'several_0.sol', 'write_first_0.sol')")
    sources, fixes = patch.remediate(files, compile_source, lambda df: spark.createDataFrame(df.toPandas(), df.schema))
    assert sources.count() == 3
    found = {r["file"] for r in fixes.collect()}
    assert found == {"owner_replaced_0.sol", "several_0.sol"}


def test_stream_equals_batch(spark, tmp_path):
    from spandrel.streaming import summary

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = summary.hourly(summary.read_stream(spark, str(tmp_path / "in"), events.schema), late="1 hour")
    summary.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    out = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in summary.hourly(events).collect()}
    # What is younger than the watermark has not been written yet.
    assert out and out <= batch and len(batch - out) <= 20


def test_features_of_a_sample(spark):
    from spandrel.plans import ast, features
    from spandrel.queries.analysis import sample_files

    nodes = ast.flatten(sample_files(spark).filter("file = 'check_call_write_0.sol'"))
    ren = features.wide(nodes, "REN-001").first().asDict()
    assert ren["external_call_count"] == 1 and ren["post_call_write_matches_read"] == 1 and ren["checks_effects_interactions"] == 0
    assert features.wide(nodes, "UEC-001").first()["result_checked_count"] >= 1
    with pytest.raises(KeyError):
        features.wide(nodes, "ABC-001")


def test_sources_and_sinks(spark, tmp_path):
    from spandrel.sources import inputs

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.sol").write_bytes(b"contract A { }\r\n")
    (tmp_path / "src" / "b.txt").write_bytes(b"no")
    got = inputs.read_sources(spark, str(tmp_path / "src")).collect()
    assert [(r["file"], r["source"], r["byte_length"]) for r in got] == [("A.sol", "contract A { }\n", 15)]
    (tmp_path / "r.json").write_text('{"fileName": "a.sol", "source": "x", "compilerOutput": "{}"}\n{"fileName": "../a", "source": " ", "compilerOutput": "{}"}\n')
    good, bad = inputs.requests(spark, str(tmp_path / "r.json"))
    assert (good.count(), bad.count()) == (1, 1)
    df = spark.createDataFrame([("noise {\"a\": 1}",), ("none",), ("[1]",)], "t string")
    assert [r[0] is not None for r in df.select(inputs.tolerant_object("t")).collect()] == [True, False, False]
    assert inputs.markdown_table(spark.createDataFrame([(1, "x")], "a int, b string")).splitlines()[0] == "| a | b |"


def test_report_invariants_hold(spark):
    from pyspark.sql import functions as F
    from spandrel.operators import report
    from spandrel.plans import rules
    from spandrel.queries.analysis import sample_files

    reports = rules.analyze(sample_files(spark))
    heads = reports.select("file", "status", F.size("findings").alias("total"), "byte_length")
    assert report.invariants(heads, rules.findings(reports), rules.results(reports)).count() == 0


def test_split_and_manifest_problems(spark):
    from spandrel.operators import quality

    splits = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "odd"), ("c", "train")], "file string, part string")
    files = spark.createDataFrame([("a",), ("b",), ("d",)], "file string")
    assert {tuple(r) for r in quality.validate_splits(splits, files).collect()} == {("a", "several parts"), ("b", "unknown part"), ("c", "no file"), ("d", "no part")}
    sources = spark.createDataFrame([("f", "one\r\ntwo\n")], "file string, source string")
    rows = spark.createDataFrame(
        [("TX-001", "f", "direct", 2, "two", [1, 2], [2]), ("TX-002", "f", "", 9, "x", [1], [2]), ("bad", "g", "safe", 1, "y", [], []), ("TX-003", "f", "safe", 1, "two", [], []), ("TX-003", "f", "safe", 1, "one", [], [])],
        "id string, file string, category string, line int, text string, evidence array<int>, expected array<int>",
    )
    got = {tuple(r) for r in quality.validate_manifest(rows, sources).collect()}
    assert got == {("TX-002", "category"), ("TX-002", "line"), ("TX-002", "stale text"), ("TX-002", "evidence"), ("bad", "id"), ("bad", "no file"), ("TX-003", "stale text"), ("TX-003", "duplicate id")}


def test_trees_are_compared_and_chosen_where_they_win(spark):
    import random

    from spandrel.plans import ml

    draw = random.Random(7)
    points = [(draw.random() - 0.5, draw.random() - 0.5) for _ in range(240)]
    rows = spark.createDataFrame([(i, int(x * y > 0), x, y) for i, (x, y) in enumerate(points)], "i int, label int, f0 double, f1 double")
    ready = ml.assembled(rows, ml.scaling(rows, 2)).persist()
    name, model, metrics = ml.fit(ready.filter("i % 3 > 0"), ready.filter("i % 3 = 0"), trees=8)
    f1 = {r["candidate"]: r["f1"] for r in metrics.collect()}
    assert set(f1) == {"dummy", "logistic_regression", "boosted_trees"} and name == "boosted_trees" and f1["boosted_trees"] > 0.8 > f1["logistic_regression"]
    assert ml.fit(ready.filter("i % 3 > 0"), ready.filter("i % 3 = 0"), trees=0)[0] != "boosted_trees" and ml.TREES > 0
    ready.unpersist()


def test_compiling_never_fails_the_job(spark):
    import time

    from spandrel.sources import inputs

    def provider(source, file):
        if source == "raise":
            raise RuntimeError("no compiler")
        if source == "sleep":
            time.sleep(5)
        return '{"errors": [{"severity": "error", "message": "bad"}]}' if source == "bad" else "not json" if source == "noise" else "{}"

    rows = spark.createDataFrame([(s, s) for s in ("raise", "sleep", "bad", "noise", "good")], "file string, source string")
    got = {r["file"]: r for r in inputs.compile_rows(rows, provider, 1.0).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"raise": "failed", "sleep": "timeout", "bad": "diagnostics", "noise": "failed", "good": "compiled"}
    assert got["bad"]["error"] == "bad" and len(got["good"]["sha256"]) == 64 and got["raise"]["output"] is None


def test_request_objects_and_named_samples(spark, tmp_path):
    from spandrel.sources import inputs

    (tmp_path / "a.json").write_text('log line\n{"fileName": "a.sol", "source": "x", "compilerOutput": {"k": [1]}}')
    (tmp_path / "b.json").write_text('{"fileName": "b.sol"}')
    (tmp_path / "c.json").write_text("nothing")
    got = sorted((r["file"] or "", r["output"] or "", r["error"] or "") for r in inputs.request_object(spark, str(tmp_path)).collect())
    assert got == [("", "", "no JSON object"), ("a.sol", '{"k":[1]}', ""), ("b.sol", "", "missing: source, compilerOutput")]
    names = spark.createDataFrame([("x",), ("../etc",)], "name string")
    allowed = spark.createDataFrame([("x", "text"), ("y", "other")], "name string, source string")
    assert {tuple(r) for r in inputs.named_samples(names, allowed).collect()} == {("x", "text", True), ("../etc", None, False)}


def test_models_are_stored_and_scores_say_what_is_missing(spark, tmp_path):
    from spandrel.plans import ml
    from spandrel.plans.features import FEATURES

    r = [(f"f{i}", rule, {n: float((i + k) % 3) for k, n in enumerate(names)}) for i in range(12) for rule, names in FEATURES.items()]
    rows = spark.createDataFrame(r, "file string, rule_id string, features map<string,double>")
    labels = spark.createDataFrame([(f"f{i}", rule, i % 2) for i in range(12) for rule in ("TXO-001", "REN-001")], "file string, rule_id string, label int")
    splits = spark.createDataFrame([(f"f{i}", "train" if i < 8 else "validation") for i in range(12)], "file string, part string")
    none = spark.createDataFrame([], "file string, rule_id string")
    models = ml.train(rows, labels, splits, trees=2)
    ml.save(models, str(tmp_path / "m"))
    again = ml.load(str(tmp_path / "m"))
    want, got = ({tuple(x) for x in ml.score(rows, m, none).select("file", "rule_id", "probability").collect()} for m in (models, again))
    assert want == got and {k: v[0] for k, v in models.items()} == {k: v[0] for k, v in again.items()}
    assert ml.readiness(again)["status"] == "ready" and ml.load(str(tmp_path / "nowhere")) == {}
    part = {k: v for k, v in again.items() if k != "TMP-001"}
    assert ml.readiness(part) == {"status": "partial", "missing": ["TMP-001"]} and ml.shadow(rows, part, none, True) is None and ml.shadow(rows, again, none, True) is not None
    assert {(x["rule_id"], x["status"]) for x in ml.scored(rows, part, none).collect()} == {(k, "error" if k == "TMP-001" else "ok") for k in FEATURES}
    assert {x["status"] for x in ml.scored(rows, {}, none).collect()} == {"unavailable"} and {x["status"] for x in ml.scored(rows, again, none, False).collect()} == {"disabled"}
    with pytest.raises(ValueError, match="without features"):
        ml.train(rows.filter("file <> 'f3'"), labels, splits, trees=0)


def test_a_fit_has_as_many_partitions_as_its_rows_ask_for(spark, monkeypatch):
    from pyspark.sql import functions as F
    from spandrel.plans import ml
    from spandrel.plans.features import FEATURES

    r = [(f"f{i}", rule, {n: float((i + k) % 3) for k, n in enumerate(names)}) for i in range(12) for rule, names in FEATURES.items()]
    rows = spark.createDataFrame(r, "file string, rule_id string, features map<string,double>").repartition(40)
    labels = spark.createDataFrame([(f"f{i}", "TXO-001", i % 2) for i in range(12)], "file string, rule_id string, label int")
    splits = spark.createDataFrame([(f"f{i}", "train" if i < 8 else "validation") for i in range(12)], "file string, part string")
    seen, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda train, valid, trees: seen.append((train.rdd.getNumPartitions(), train.count(), valid.count())) or fit(train, valid, trees))
    ml.train(rows, F.broadcast(labels), F.broadcast(splits), trees=0)
    assert seen == [(1, 8, 4)] * 5


def test_unknown_where_a_graph_is_uncertain(spark):
    from spandrel.operators import graph as G

    nodes = spark.createDataFrame([("g", i, i == 0, i == 2, i == 1, False) for i in range(4)], "graph string, id int, entry boolean, exit boolean, uncertain boolean, unordered boolean")
    edges = spark.createDataFrame([("g", 0, 1, "normal"), ("g", 0, 3, "normal")], "graph string, src int, dst int, kind string")
    asked = spark.createDataFrame([("g", 0, 2), ("g", 0, 3), ("g", 0, 9), ("h", 0, 0)], "graph string, src int, dst int")
    got = {tuple(r) for r in G.reachable(asked, edges, nodes).collect()}
    assert got == {("g", 0, 2, "unknown"), ("g", 0, 3, "yes"), ("g", 0, 9, "invalid"), ("h", 0, 0, "invalid")}
    asked = spark.createDataFrame([("g", 1, 3), ("g", 1, 2), ("g", 3, 3), ("g", 7, 3), ("h", 0, 0)], "graph string, dominator int, target int")
    assert {tuple(r) for r in G.dominates(asked, edges, nodes).collect()} == {("g", 1, 3, "no"), ("g", 1, 2, "unknown"), ("g", 3, 3, "yes"), ("g", 7, 3, "invalid"), ("h", 0, 0, "invalid")}


def test_annotations_and_spans(spark, tmp_path):
    from pyspark.sql import functions as F
    from spandrel.functions import text as T
    from spandrel.operators import quality
    from spandrel.sources import inputs

    assert spark.createDataFrame([("é=1;",)], "s string").select(T.byte_slice(F.col("s"), F.lit(2), F.lit(2))).first()[0] in ("=1", b"=1", bytearray(b"=1"))
    inputs.write_json(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"sources": {"a.sol": {}}}')
    assert inputs.read_compiled(spark, str(tmp_path / "in")).first()["file"] == "a.sol"
    rows = spark.createDataFrame(
        [("a", "TXO-001", "present", "0" * 64, True), ("b", "TXO-001", "present", "0" * 64, None), (" ", "X", "maybe", "0" * 63, True), ("c", None, None, None, False), ("a", "ACC-001", "unknown", "f" * 64, False)],
        "sample_id string, rule_id string, label string, sha256 string, reviewed boolean",
    )
    got = sorted(map(tuple, quality.validate_annotations(rows).collect()))
    assert got == [(" ", "empty id"), (" ", "hash"), (" ", "label"), (" ", "rule"), ("a", "duplicate id"), ("b", "not reviewed"), ("c", "hash"), ("c", "label"), ("c", "not reviewed"), ("c", "rule")]


def test_reports_are_written_whole_and_sorted(spark, tmp_path):
    from pyspark.sql import functions as F
    from spandrel.sources import inputs

    rows = spark.range(1500).select(F.col("id").alias("z"), F.struct(F.lit(1).alias("y"), F.array(F.struct(F.lit(2).alias("q"), F.lit(3).alias("p"))).alias("b")).alias("a"), F.lit("x|y\nz").alias("m"), F.create_map(F.lit("k"), F.lit(1), F.lit("j"), F.lit(2)).alias("d"))
    inputs.write_json(rows, str(tmp_path / "j"))
    line = spark.read.text(str(tmp_path / "j")).filter("value LIKE '%\"z\":7}'").first()["value"]
    assert line == '{"a":{"b":[{"p":3,"q":2}],"y":1},"d":{"j":2,"k":1},"m":"x|y\\nz","z":7}'
    inputs.write_markdown(rows.select("z", "m"), str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t" / "0-head")).collect()] == ["| z | m |", "| --- | --- |"]
    assert spark.read.text(str(tmp_path / "t" / "1-rows")).count() == 1500 and inputs.markdown_table(rows.select("z", "m")).splitlines()[2] == "| 0 | x\\|y<br>z |"


def test_what_meets_the_limit_is_ended(spark, tmp_path):
    import time

    from spandrel.sources import inputs

    def provider(source, file):
        time.sleep(3)
        with open(source, "w"):
            return "{}"

    late = str(tmp_path / "late")
    got = inputs.compile_rows(spark.createDataFrame([("a", late)], "file string, source string"), provider, 0.5).collect()
    time.sleep(4)
    assert [r["status"] for r in got] == ["timeout"] and not os.path.exists(late)


def test_source_trees(spark, tmp_path):
    from pyspark.errors import PySparkException
    from spandrel.sources import source_tree

    source_tree.register(spark)
    root = tmp_path / "tree"
    (root / "b" / "c").mkdir(parents=True)
    (root / "a.sol").write_bytes("é\r\nx\r".encode())
    (root / "b" / "c" / "d.sol").write_bytes(b"")
    (root / "b" / "bad.sol").write_bytes(b"\xff\xfe")
    (root / "b" / "other.txt").write_bytes(b"no")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "x.sol").write_bytes(b"secret")
    (root / "link.sol").symlink_to(tmp_path / "outside" / "x.sol")
    (root / "linked").symlink_to(tmp_path / "outside")
    (root / "gone.sol").write_bytes(b"x")
    (root / "gone.sol").chmod(0)
    read = lambda **o: spark.read.format("source_tree").options(pattern="*.sol", **o).load(str(root))
    got = {r["file"]: (r["source"], r["byte_length"], r["status"]) for r in read().collect()}
    # The superuser reads what nobody may.
    assert got.pop("gone.sol") in ((None, None, "unreadable"), ("x", 1, "ok"))
    assert got == {"a.sol": ("é\nx\r", 5, "ok"), "b/c/d.sol": ("", 0, "ok"), "b/bad.sol": (None, None, "not UTF-8"), "link.sol": (None, None, "symlink"), "linked": (None, None, "symlink")}
    assert read(partition_bytes=1).rdd.getNumPartitions() > 1
    rows = spark.createDataFrame([(f"{i % 3}/{i}.txt", "x" * i) for i in range(30)] + [("null.txt", None)], "file string, source string").repartition(3)
    out = str(tmp_path / "out")
    for _ in range(2):
        rows.write.format("source_tree").mode("overwrite").save(out)
    back = spark.read.format("source_tree").load(out)
    assert sorted((r["file"].split("/", 1)[1], r["source"]) for r in back.collect()) == sorted((r["file"], r["source"] or "") for r in rows.collect())
    for name in ("../evil", "/etc/evil", None, "."):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(name, "x")], "file string, source string").write.format("source_tree").mode("append").save(out)
    assert spark.read.format("source_tree").load(out).count() == 31
    (tmp_path / "out" / "_writing-x").mkdir()
    (tmp_path / "out" / "_writing-x" / "y").write_bytes(b"y")
    assert spark.read.format("source_tree").load(out).count() == 31
    with pytest.raises(ValueError, match="mounted"):
        source_tree.local_path("hdfs://x/y")
