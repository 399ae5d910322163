"""Queries over control-flow graphs held as tables.

``nodes(graph, id, entry, exit, uncertain)`` and ``edges(graph, src, dst, kind)``.
Answers are ``yes``, ``no``, ``unknown`` (the graph is not complete) or ``invalid``.
A graph is small, so it is walked where its rows are, one graph a call, from the nodes
that are asked for alone; the graphs themselves are spread.  A single large graph goes
by ``large_graph`` instead.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reach(adjacency: dict, start, without=None) -> set:
    """Nodes reached from ``start`` by at least one edge, on paths that don't pass ``without``."""
    seen: set = set()
    todo = list(adjacency.get(start, ()))
    while todo:
        node = todo.pop()
        if node not in seen and (without is None or node != without):
            seen.add(node)
            todo.extend(adjacency.get(node, ()))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """``(graph, src, dst)``: all pairs joined by a path of one edge or more."""
    types = dict(edges.dtypes)

    def per_graph(table: pa.Table) -> pa.Table:
        adjacency = defaultdict(list)
        for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
            adjacency[a].append(b)
        pairs = [(a, b) for a in list(adjacency) for b in sorted(reach(adjacency, a))]
        graph = pa.array([table.column("graph")[0].as_py()] * len(pairs), table.schema.field("graph").type)
        return pa.table({"graph": graph, "src": pa.array([a for a, _ in pairs], table.schema.field("src").type), "dst": pa.array([b for _, b in pairs], table.schema.field("dst").type)})

    return edges.select("graph", "src", "dst").groupBy("graph").applyInArrow(per_graph, f"graph {types['graph']}, src {types['src']}, dst {types['dst']}")


def asked_closure(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(graph, src, dst)`` that a path of one edge or more joins, each once; one walk for each asked ``src``."""
    types = dict(pairs.dtypes)

    def per_graph(asked: pa.Table, graph: pa.Table) -> pa.Table:
        adjacency = defaultdict(list)
        for a, b in zip(graph.column("src").to_pylist(), graph.column("dst").to_pylist(), strict=True):
            adjacency[a].append(b)
        found: dict = {}
        hits = []
        for a, b in zip(asked.column("src").to_pylist(), asked.column("dst").to_pylist(), strict=True):
            if a not in found:
                found[a] = reach(adjacency, a)
            hits.append(b in found[a])
        return asked.filter(pa.array(hits, pa.bool_()))

    # Names of its own, as pairs may come from the table of the edges.
    asked = pairs.select(*(F.col(c).alias(c) for c in ("graph", "src", "dst"))).distinct()
    return asked.groupBy("graph").cogroup(edges.select("graph", "src", "dst").groupBy("graph")).applyInArrow(per_graph, f"graph {types['graph']}, src {types['src']}, dst {types['dst']}")


def status(reached: Column, complete: Column, valid: Column) -> Column:
    """The four-valued answer."""
    return F.when(~valid, "invalid").when(reached, "yes").when(complete, "no").otherwise("unknown")


def reachable(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Answers for ``pairs(graph, src, dst)``: is there a path from src to dst; a node reaches itself."""
    closed = asked_closure(edges, pairs)
    known = nodes.select("graph", "id")
    whole = nodes.groupBy("graph").agg((F.count_if("uncertain") == 0).alias("complete"))
    q = pairs.join(known.select("graph", F.col("id").alias("src"), F.lit(True).alias("_a")), ["graph", "src"], "left")
    q = q.join(known.select("graph", F.col("id").alias("dst"), F.lit(True).alias("_b")), ["graph", "dst"], "left").join(whole, "graph", "left")
    q = q.join(closed.withColumn("_hit", F.lit(True)), ["graph", "src", "dst"], "left")
    valid = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    hit = F.col("_hit").isNotNull() | (F.col("src") == F.col("dst"))
    return q.select("graph", "src", "dst", status(hit, F.coalesce("complete", F.lit(False)), valid).alias("status"))


def with_reasons(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``answers(graph, src, dst, status, ...)`` with ``reason``: what makes an answer invalid or leaves it unknown, else null."""
    known = nodes.select("graph", "id").distinct()
    rows = answers.join(known.select("graph", F.col("id").alias("src"), F.lit(True).alias("_src")), ["graph", "src"], "left").join(known.select("graph", F.col("id").alias("dst"), F.lit(True).alias("_dst")), ["graph", "dst"], "left")
    rows = rows.join(known.select("graph", F.lit(True).alias("_graph")).distinct(), "graph", "left")
    invalid = F.when(F.col("_graph").isNull(), "no such graph").when(F.col("_src").isNull() & F.col("_dst").isNull(), "no such nodes").when(F.col("_src").isNull(), "no such source").when(F.col("_dst").isNull(), "no such target")
    return rows.select(*answers.columns, F.when(F.col("status") == "invalid", invalid).when(F.col("status") == "unknown", F.lit("the graph is not complete")).alias("reason"))


def ordered(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As reachable(), but strict: a node does not come before itself unless by a cycle."""
    answers = reachable(pairs.filter("src <> dst"), edges, nodes)
    same = pairs.filter("src = dst")
    same = same.join(asked_closure(edges, same).withColumn("_hit", F.lit(True)), ["graph", "src", "dst"], "left")
    return answers.union(same.select("graph", "src", "dst", F.when(F.col("_hit").isNotNull(), "yes").otherwise("no").alias("status")))


def ordered_sequences(sequences: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sequences(graph, seq, nodes ARRAY)``: the least answer over neighbours; an empty sequence is invalid."""
    steps = sequences.select("graph", "seq", F.explode(F.arrays_zip(F.expr("slice(nodes, 1, greatest(size(nodes) - 1, 0))").alias("src"), F.expr("slice(nodes, 2, size(nodes))").alias("dst"))).alias("e")).select("graph", "seq", "e.src", "e.dst")
    answers = steps.join(ordered(steps.select("graph", "src", "dst").distinct(), edges, nodes), ["graph", "src", "dst"])
    rank = F.when(F.col("status") == "invalid", 0).when(F.col("status") == "no", 1).when(F.col("status") == "unknown", 2).otherwise(3)
    worst = answers.groupBy("graph", "seq").agg(F.min_by("status", rank).alias("status"))
    return sequences.select("graph", "seq", F.size("nodes").alias("_n")).join(worst, ["graph", "seq"], "left").select("graph", "seq", F.when(F.col("_n") == 0, "invalid").otherwise(F.coalesce("status", F.lit("yes"))).alias("status"))


def ordered_effects(pairs: DataFrame, effects: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs(graph, first, second)`` of effects by id: can the first come before the second, by the nodes that hold them.

    ``effects(graph, id, node)``.  Two effects of one node have no known order where the
    node is uncertain or unordered, and are not strictly ordered else.
    """
    held = effects.groupBy("graph", "id").agg(F.min("node").alias("node"))
    found = pairs.join(held.select("graph", F.col("id").alias("first"), F.col("node").alias("src")), ["graph", "first"], "left").join(held.select("graph", F.col("id").alias("second"), F.col("node").alias("dst")), ["graph", "second"], "left")
    loose = nodes.select("graph", F.col("id").alias("src"), (F.col("uncertain") | F.col("unordered")).alias("_loose"))
    answers = ordered(found.filter("src <> dst").select("graph", "src", "dst").distinct(), edges, nodes)
    out = found.join(answers, ["graph", "src", "dst"], "left").join(loose, ["graph", "src"], "left")
    same = F.when(F.col("_loose"), "unknown").otherwise("no")
    return out.select("graph", "first", "second", F.when(F.col("src").isNull() | F.col("dst").isNull(), "invalid").when(F.col("src") == F.col("dst"), same).otherwise(F.col("status")).alias("status"))


def branch_reachable(queries: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``queries(graph, branch, kind, target)``: does the edge of that kind lead to the target."""
    heads = queries.join(edges.select("graph", F.col("src").alias("branch"), "kind", F.col("dst").alias("src")), ["graph", "branch", "kind"], "left")
    asked = heads.filter(F.col("src").isNotNull()).select("graph", "src", F.col("target").alias("dst")).distinct()
    answers = reachable(asked, edges, nodes)
    out = heads.join(answers.select("graph", "src", F.col("dst").alias("target"), "status"), ["graph", "src", "target"], "left")
    rank = F.when(F.col("status") == "yes", 0).when(F.col("status") == "unknown", 1).when(F.col("status") == "no", 2).otherwise(3)
    return out.groupBy("graph", "branch", "kind", "target").agg(F.min_by(F.coalesce("status", F.lit("invalid")), rank).alias("status"))


def dominates(queries: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``queries(graph, dominator, target)``: does every path from the entry to the target pass the dominator.

    A graph's queries meet its edges once; one walk around each dominator answers for all of its targets.
    """
    types = dict(queries.dtypes)
    shape = nodes.select("graph", F.col("id").alias("src"), F.lit(None).cast(types["target"]).alias("dst"), F.col("entry"), F.col("uncertain"))
    parts = shape.union(edges.select("graph", "src", "dst", F.lit(None).cast("boolean"), F.lit(None).cast("boolean")))

    def answer(asked: pa.Table, graph: pa.Table) -> pa.Table:
        ids, start, complete, adjacency = set(), None, True, defaultdict(list)
        for r in graph.to_pylist():
            if r["entry"] is None:
                adjacency[r["src"]].append(r["dst"])
            else:
                ids.add(r["src"])
                start = r["src"] if r["entry"] else start
                complete = complete and not r["uncertain"]
        around: dict = {}

        def status(d, t) -> str:
            if d not in ids or t not in ids:
                return "invalid"
            if d in (start, t):
                return "yes"
            if d not in around:
                around[d] = reach(adjacency, start, d) | {start}
            return "no" if t in around[d] else "yes" if complete else "unknown"

        answers = [status(d, t) for d, t in zip(asked.column("dominator").to_pylist(), asked.column("target").to_pylist(), strict=True)]
        return asked.append_column("status", pa.array(answers, pa.string()))

    # Names of its own, as queries and nodes may come from one table.
    asked = queries.select(*(F.col(c).alias(c) for c in ("graph", "dominator", "target")))
    return asked.groupBy("graph").cogroup(parts.groupBy("graph")).applyInArrow(answer, f"graph {types['graph']}, dominator {types['dominator']}, target {types['target']}, status string")
