"""Graphs, classes, windows, paths and pending calls in rounds of joins, against plain versions."""

from __future__ import annotations

import collections
import random

import pytest
from spandrel.operators import bounded_paths, equalities, large_graph, open_windows, sketches, spans, variants


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def walk(edges, start, without=None):
    seen, todo = ({start} if start != without else set()), [start] if start != without else []
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_search_from_many_starts(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(150), draw.randrange(150)) for _ in range(600)] + [(7, 7), (3, None), (None, 4)] + [(5, 6)] * 4
    known = [(a, b) for a, b in edges if a is not None and b is not None]
    df = spark.createDataFrame(edges, "src int, dst int")
    starts = spark.createDataFrame([(i,) for i in range(0, 150, 2)] + [(2,), (None,)], "id int")
    got = {(r["src"], r["dst"]) for r in large_graph.reached(df, starts).collect()}
    assert got == {(s, t) for s in range(0, 150, 2) for t in walk(known, s)}
    pairs = spark.createDataFrame([(0, 5), (8, 8), (8, 149), (8, 400), (400, 8), (None, 3)], "src int, dst int")
    for uncertain in (False, True):
        nodes = spark.createDataFrame([(i, uncertain and i == 140) for i in range(150)], "id int, uncertain boolean")
        answer = {(r["src"], r["dst"]): r["status"] for r in large_graph.reachable(pairs, df, nodes).collect()}
        no = "unknown" if uncertain else "no"
        assert answer == {(0, 5): "yes" if 5 in walk(known, 0) else no, (8, 8): "yes", (8, 149): "yes" if 149 in walk(known, 8) else no, (8, 400): "invalid", (400, 8): "invalid", (None, 3): "invalid"}


def test_dominator_trees(spark, monkeypatch):
    from spandrel.operators import graph

    monkeypatch.setattr(large_graph, "TOGETHER", 2)
    draw = random.Random(3)
    sizes = {g: draw.randint(2, 14) for g in range(12)}
    edges = [(g, draw.randrange(n), draw.randrange(n)) for g, n in sizes.items() for _ in range(int(1.6 * n))] + [(20, i, i + 1) for i in range(6)] + [(20, 6, 2), (20, 1, 5), (21, 4, 4)] + [(23, 0, 9), *((23, i + 1, i) for i in range(1, 9)), (23, 5, 7)]
    ids = sorted({(g, x) for g, a, b in edges for x in (a, b)} | {(g, 0) for g in (*sizes, 20, 22, 23)})
    want = {}
    for g in {g for g, _ in ids}:
        own = [(a, b) for h, a, b in edges if h == g]
        live = walk(own, 0) if (g, 0) in ids else set()
        above = {v: {d for d in live if d != v and (d == 0 or v not in walk(own, 0, d))} for v in live}
        want |= {(g, v): (max(s, key=lambda d: len(above[d])) if (s := above[v]) else None, len(s)) for v in live}  # noqa: B023
    nodes = spark.createDataFrame([(g, x, x == 0, g == 3 and x == 1) for g, x in ids], "graph int, id int, entry boolean, uncertain boolean")
    df = spark.createDataFrame(edges, "graph int, src int, dst int")
    tree = large_graph.dominator_tree(nodes, df)
    assert {(r["graph"], r["id"]): (r["idom"], r["depth"]) for r in tree.collect()} == want
    pairs = spark.createDataFrame([(g, draw.choice(ids)[1], draw.choice(ids)[1]) for g in (*sizes, 20, 22, 99) for _ in range(8)], "graph int, dominator int, target int")
    assert {tuple(r) for r in large_graph.dominates(pairs, tree, nodes).collect()} == {tuple(r) for r in graph.dominates(pairs.distinct(), df, nodes).collect()}


@pytest.mark.parametrize("near", [2, 3, 128])
def test_nearest_common_ancestors(spark, monkeypatch, near):
    monkeypatch.setattr(large_graph, "NEAR", near)
    draw = random.Random(near)
    parent = {0: None, **{i: draw.randrange(max(0, i - 3), i) for i in range(1, 25)}}
    up = lambda v: [v, *(up(parent[v]) if parent[v] is not None else [])]
    tree, deepest = large_graph._tree(spark.createDataFrame([(1, i, p) for i, p in parent.items()], "graph int, id int, parent int"))
    assert {r["id"]: r["depth"] for r in tree.collect()} == {i: len(up(i)) - 1 for i in parent} and deepest == max(len(up(i)) - 1 for i in parent)
    both = [(draw.randrange(25), draw.randrange(25)) for _ in range(40)]
    got = large_graph.nearest_common(spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(both)], "graph int, id int, a int, b int"), tree, deepest)
    assert {(r["id"], r["nca"], r["nca_depth"]) for r in got.collect()} == {(i, c := next(x for x in up(a) if x in up(b)), len(up(c)) - 1) for i, (a, b) in enumerate(both)}
    got = large_graph.ancestor(spark.createDataFrame([(1, a, b) for a, b in {*both, (99, 1)}], "graph int, above int, below int"), tree, deepest)
    assert {(r["above"], r["below"], r["is"]) for r in got.collect()} == {(a, b, a in up(b)) for a, b in both} | {(99, 1, None)}


def test_classes_and_contradictions(spark):
    facts = [
        ("s", "a", "==", "b"), ("s", "c", "==", "b"), ("s", "c", "!=", "a"), ("s", "c", "!=", "a"), ("s", "d", "!=", "a"), ("t", "a", "==", "lit:1"), ("t", "b", "==", "lit:2"), ("t", "a", "==", "b"),
        ("u", "a", "!=", "a"), (None, "x", "==", "y"), (None, "y", "!=", "x"), ("v", "a", "<", "b"), ("v", None, "==", "b"), ("w", "p", "!=", "q"),
    ]
    df = spark.createDataFrame(facts, "scope string, left string, op string, right string")
    found = equalities.classes(df)
    assert {tuple(r) for r in found.collect()} >= {("s", "c", "a"), ("s", "d", "d"), ("t", "lit:2", "a"), (None, "y", "x"), ("w", "q", "q")}
    assert {tuple(r) for r in equalities.contradictions(df, found).collect()} == {("s", "a", "c", "a", "different"), ("t", "a", "lit:1", "lit:2", "literals"), ("u", "a", "a", "a", "different"), (None, "x", "y", "x", "different")}
    assert {tuple(r) for r in equalities.judged(df).collect()} == {("s", "a", 3, 1), ("t", "a", 4, 1), ("u", "a", 1, 1), (None, "x", 2, 1)}


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(500, 600 + i) for i in range(50)] + [(7, 7), (900, 901)]
    random.Random(4).shuffle(pairs)
    got = {r["id"]: r["root"] for r in large_graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 500: 500, **dict.fromkeys(range(600, 650), 500), 900: 900, 901: 900}
    assert large_graph.components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_closing_writes(spark):
    from pyspark.sql import functions as F

    draw = random.Random(5)
    some = lambda *x: draw.choice(x)
    windows = [(i, some(1, 1, 1, 2, None), some("x", "y"), some(1, 2, None), some(None, *range(40)), "extra") for i in range(90)]
    writes = [(some(1, 1, 1, 2, None), some("x", "y"), some(1, 2, 3, None), some(None, *range(40)), 1000 + i) for i in range(60)]
    want = collections.Counter()
    for w, scope, base, key, at, _ in windows:
        later = sorted((t, i, k) for s, b, k, t, i in writes if s == scope and b == base and at is not None and t is not None and t > at and (k == key or k is None or key is None)) if at is not None else []
        want[(w, later[0][1] if later else None, "open" if not later else "same" if later[0][2] == key and key is not None else "maybe")] += 1
    a = spark.createDataFrame(windows, "w int, scope int, base string, key int, at int, closed string")
    b = spark.createDataFrame(writes, "scope int, base string, key int, at int, id int")
    for bucket in (F.floor(F.col("at") / 7), F.lit(0), F.col("at").cast("long")):
        out = open_windows.closed_by(a, b, bucket)
        got = collections.Counter((r["w"], r["closed_by"], r["alias"]) for r in out.collect())
        # Of writes at one place, a known and an unknown key may both come first.
        assert got == want
    assert open_windows.closed_by(a.limit(0), b, F.lit(0)).collect() == [] and {r["alias"] for r in open_windows.closed_by(a, b.limit(0), F.lit(0)).collect()} == {"open"}


def test_paths_within_a_budget(spark):
    diamond = [("d", 0, 1), ("d", 0, 2), ("d", 1, 3), ("d", 2, 3), ("d", 0, 3), ("d", 3, 77)]
    loop = [("l", 0, 1), ("l", 1, 0), ("l", 1, 2)]
    wide = [("w", i, j) for i in range(8) for j in range(i + 1, 8)]
    edges = spark.createDataFrame(diamond + diamond + loop + wide + [("n", 0, 1), ("z", 0, 0)], "graph string, src int, dst int")
    node = lambda g, n, last, entry=True: [(g, i, entry and i == 0, i == last) for i in range(n)]
    nodes = spark.createDataFrame(node("d", 4, 3) * 2 + node("l", 3, 2) + node("w", 8, 7) + node("n", 2, 1, False) + node("z", 1, 0) + node("one", 1, 0), "graph string, id int, entry boolean, exit boolean")
    answers, paths = bounded_paths.paths(nodes, edges, 127)
    assert {tuple(r) for r in answers.collect()} == {("d", "complete", 6), ("l", "unknown", None), ("w", "unknown", None), ("z", "unknown", None), ("one", "complete", 1)}
    assert sorted((r["graph"], *r["path"]) for r in paths.collect()) == [("d", 0, 1, 3), ("d", 0, 2, 3), ("d", 0, 3), ("one", 0)]
    answers, paths = bounded_paths.paths(nodes, edges, 128)
    assert ("w", "complete", 128) in {tuple(r) for r in answers.collect()} and paths.filter("graph = 'w'").count() == 64


def folded(log, gap):
    out = []
    for key in {r[0] for r in log if r[0] is not None}:
        calls, last = [], None
        for _, at, i, kind in sorted((r for r in log if r[0] == key and r[1] is not None and r[2] is not None), key=lambda r: r[1:3]):
            if last is not None and (at - last).total_seconds() > gap:
                calls = []
            last = at
            if kind == "call":
                calls.append([i, "unhandled"])
            elif kind in ("handler", "escape"):
                for c in calls:
                    c[1] = c[1] if c[1] != "unhandled" else "handled" if kind == "handler" else "escaped"
            elif kind in ("success", "failure"):
                out += [(key, c, s, i) for c, s in calls if kind == "success"]
                calls = []
    return sorted(out)


def test_pending_calls_of_a_table_and_a_stream(spark, tmp_path):
    import datetime

    from spandrel.streaming import calls, summary

    draw = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    kinds = ["call", "call", "call", "handler", "escape", "success", "success", "failure", "other", None]
    log = [(draw.randrange(5), start + datetime.timedelta(minutes=draw.randrange(4000), microseconds=draw.choice([0, 0, 7])), i, draw.choice(kinds)) for i in range(400)] + [(None, start, 900, "call"), (1, None, 901, "call"), (1, start, None, "call")]
    schema = "key int, ts timestamp, id long, kind string"
    table = spark.createDataFrame(log, schema)
    want = folded(log, 1800)
    assert want and sorted(map(tuple, calls.settled(table, 1800).collect())) == want
    assert calls.settled(table.limit(0), 1800).collect() == []
    # A last row, long after, lets the watermark pass all others.
    end = spark.createDataFrame([(99, start + datetime.timedelta(days=30), 999, "other")], schema)
    for i, part in enumerate((table.filter("id % 2 = 0 OR id IS NULL"), table.filter("id % 2 = 1"), end)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = summary.read_stream(spark, str(tmp_path / "in" / "*"), table.schema)
        summary.start(calls.settled_stream(source, 1800, "5 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(200)
    finally:
        spark.conf.unset(store)
    got = spark.read.schema("key int, id long, status string, ended_by long").parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == want


def enclosers(rows, doc, i, a, b, skip):
    """Spans of the document around (a, b): wider ones, or equal ones with a smaller id or, for repeated ones, an earlier row."""
    out = []
    for n, (d, j, x, y) in enumerate(rows):
        if n == skip or d != doc or x is None or y is None or x >= y or j is None:
            continue
        if a == b and x < a and b < y or a < b and x <= a and b <= y and (y - x > b - a or (j, n) < (i, skip)):
            out.append((y - x, j, n))
    return out


@pytest.mark.parametrize("stretch", [4, 1000])
def test_spans_within_spans(spark, stretch):
    draw = random.Random(stretch)
    rows = []

    def fill(doc, a, b, ids):
        while a < b and len(rows) < 400:
            end = draw.randint(a, b)
            rows.append((doc, next(ids), a, end))
            if end - a > 1 and draw.random() < 0.7:
                fill(doc, a + draw.randint(0, 1), end - draw.randint(0, 1), ids)
            a = end + draw.randint(0, 2) if end > a else a + 1

    for doc in (1, 2, None):
        fill(doc, 0, 40, iter(range(1000)))
    rows += [(1, 1, *next(r[2:] for r in rows if r[0] == 1 and r[1] == 1)), (4, 1, 5, 3), (4, None, 1, 2), (4, 2, None, 2), (5, 7, 3, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc int, id int, start int, end int, depth string")
    want = collections.Counter()
    for n, (doc, i, a, b) in enumerate(rows):
        if i is not None and a is not None and a <= b:
            around = enclosers(rows, doc, i, a, b, n)
            want[(doc, i, a, b, len(around), min(around, key=lambda x: (x[0], -x[1], -x[2]))[1] if around else None, False)] += 1
    assert collections.Counter(map(tuple, spans.nested(df, stretch).collect())) == want
    crossing = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 15), (2, 1, 0, 10), (2, 2, 3, 4), (3, 1, 0, 4), (3, 2, 2, 9), (3, 3, 3, 4)], "doc int, id int, start int, end int")
    assert {(r["doc"], r["tangled"]) for r in spans.nested(crossing, stretch).collect()} == {(1, True), (2, False), (3, True)}
    places = spark.createDataFrame([(2, 3, "a"), (2, 3, "b"), (2, 4, "c"), (2, 10, "d"), (1, 2, "e"), (9, 1, "f")], "doc int, place int, id string")
    assert {(r["id"], r["span"]) for r in spans.enclosing(crossing, places, stretch).collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", None), ("e", None), ("f", None)}


def test_nodes_of_nested_values(spark):
    import json

    values = [{"b": [1, {"c": None}, [], {}], "a": "x"}, [[["deep"]]], 5, None, {}, [True, 1.5]]
    rows = [(i, 7, json.dumps(v)) for i, v in enumerate(values)] + [(100, 7, "no json"), (101, 7, None), (2, 7, "5")]
    got = variants.walk(spark.createDataFrame(rows, "k int, name_ int, j string"), "j")

    def nodes(v, name, parent, depth, out):
        me = len(out)
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "scalar"
        out.append((me, parent, depth, name, kind, None if kind != "scalar" or v is None else v if isinstance(v, str) else json.dumps(v)))
        for key, x in sorted(v.items()) if kind == "object" else [(f"[{i}]", x) for i, x in enumerate(v)] if kind == "array" else []:
            nodes(x, key, me, depth + 1, out)
        return out

    want = collections.Counter((i, 7, *n) for i, _, j in rows if j not in (None, "no json") for n in nodes(json.loads(j), "$", None, 0, []))
    assert got.columns == ["k", "name_", "node", "parent", "depth", "name", "kind", "scalar"]
    assert collections.Counter(map(tuple, got.collect())) == want


def test_ranks_of_merged_sketches(spark):
    from pyspark.sql import functions as F

    draw = random.Random(8)
    rows = [(some, i % 24, draw.lognormvariate(0, 2) if i % 3 else float(i % 50)) for some in ("a", "b", None) for i in range(20_000)] + [("none", 1, None), ("one", 1, 4.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "g string, hour int, x double")
    parts = sketches.sketched(df, ["g", "hour"], F.col("x"))
    assert parts.filter("g = 'a'").count() == 24
    whole = sketches.merged(parts, ["g"])
    assert {(r["g"], r["n"], r["greatest"]) for r in whole.filter("g IN ('none', 'one')").collect()} == {("none", 0, None), ("one", 1, 4.0)}
    found = sketches.rank_errors(df, ["g"], F.col("x"), sketches.quantiles(whole, ["g"], [0.0, 0.5, 0.95, 0.99, 1.0]))
    errors = {(r["g"], r["share"]): r["error"] for r in found.collect()}
    assert len(errors) == 20 and max(errors.values()) < 0.015
    assert sketches.quantiles(sketches.sketched(df.limit(0), ["g"], F.col("x")), ["g"], [0.5]).collect() == []


def test_logistic_regressions_of_groups(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from spandrel.plans import newton

    draw = np.random.default_rng(9)
    rows = []
    for g, n in (("a", 400), ("b", 60), ("one class", 30), ("few", 2)):
        x = draw.normal(size=(n, 3)) * [1, 5, 0.1]
        y = (draw.random(n) < 1 / (1 + np.exp(-(x @ [1, -0.3, 4] + 0.5)))).astype(int) if g != "one class" else np.ones(n, int)
        rows += [(g, int(k), *map(float, v)) for k, v in zip(y, x, strict=True)]
    bad = [(None, 1, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 1, float("nan"), 0.0, 0.0), ("b", 1, None, 0.0, 0.0), ("b", 0, 0.0, float("inf"), 0.0)]
    df = spark.createDataFrame(rows + bad, "g string, y int, p double, q double, r double").repartition(3)
    for balanced in (False, True):
        fitted = newton.fit(df, "g", "y", ["p", "q", "r"], ridge=0.7, balanced=balanced, most_steps=15)
        got = {r["g"]: r for r in fitted.collect()}
        assert set(got) == {"a", "b", "one class", "few"} and all(r["converged"] for r in got.values())
        for g in ("a", "b", "few") if balanced else got:
            own = np.array([r[1:] for r in rows if r[0] == g])
            x, y, b = np.c_[np.ones(len(own)), own[:, 1:]], own[:, 0], np.array(got[g]["coefficients"])
            w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
            assert got[g]["n"] == len(own) and np.abs(x.T @ (w * (y - 1 / (1 + np.exp(-x @ b)))) - 0.7 * b).max() < 1e-6
    scored = newton.probability(df.filter("g = 'a' AND y IN (0, 1) AND NOT isnan(p)"), "g", ["p", "q", "r"], fitted)
    hit = scored.agg(F.avg(((F.col("probability") > 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
    assert hit > 0.75 and newton.fit(df.limit(0), "g", "y", ["p"]).collect() == []


def test_spans_are_swept_in_as_many_tasks_as_their_marks_ask_for(spark, monkeypatch):
    seen, written = [], spans.written
    monkeypatch.setattr(spans, "TASK_MARKS", 10, raising=False)
    monkeypatch.setattr(spans, "written", lambda df: seen.append(df.rdd.getNumPartitions()) or written(df))
    rows = spark.createDataFrame([(d, i, i, 20 - i) for d in range(20) for i in range(5)], "doc int, id int, start int, end int")
    assert {(r["id"], r["depth"], r["parent"], r["tangled"]) for r in spans.nested(rows).collect()} == {(i, i, i - 1 if i else None, False) for i in range(5)}
    assert max(seen) == 20


def test_equal_symbols_are_found_from_the_columns_they_need(spark, monkeypatch):
    from spandrel.queries import structure

    taken = []
    monkeypatch.setattr(structure.equalities, "judged", lambda facts: taken.append(facts) or facts)
    structure.equality_classes(spark, "/root/testdata/sf0.001")
    plan = taken[0]._jdf.queryExecution().optimizedPlan().toString()
    days = [line for line in plan.splitlines() if "windowspecdefinition(l_suppkey" in line]
    assert days and not any("l_extendedprice" in line for line in days)
