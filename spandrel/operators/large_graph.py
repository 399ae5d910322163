"""Graphs of any size as tables of edges: reachability, dominator trees and classes of equals in rounds of joins.

Nothing here holds a graph, or a node's neighbours, in one task's memory.  Each round
works on what the round before has changed and ends when that is nothing; rounds are
written to the shared checkpoint folder.  Sums over a node's edges are combined before
they are shuffled, and adaptive execution splits joins with a node of very many edges.

Edge cases: edges with a null end are ignored, repeated edges count once, a loop from a
node to itself changes nothing; ids that no edge or node holds are ``invalid`` in
answers; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import status
from .rounds import removed, written

#: Starting nodes that share a row of the search: one bit each.
_BITS = 64
_BUCKET = 4096


def _places(starts: DataFrame) -> DataFrame:
    """``(start, block, bit)``: every start's bit in the 64-bit mask of a block."""
    ids = starts.select(F.col("id").alias("start")).filter("start IS NOT NULL").distinct()
    buckets = -(-max(ids.count(), 1) // _BUCKET)
    slot = F.row_number().over(Window.partitionBy("_bucket").orderBy("start")) - 1
    placed = ids.withColumn("_bucket", F.pmod(F.xxhash64("start"), F.lit(buckets))).withColumn("_slot", slot)
    block = F.col("_bucket") * F.lit(1 << 20) + F.floor(F.col("_slot") / _BITS)
    return placed.select("start", block.cast("long").alias("block"), F.expr(f"shiftleft(1L, CAST(_slot % {_BITS} AS INT))").alias("bit"))


def search(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from all ``starts(id)`` at once over ``edges(src, dst)``.

    Returns the starts' places and ``(id, block, mask, hops)``: the bits of the starts that first
    reach a node after so many hops.  A row carries up to 64 starts, so a round moves
    masks instead of pairs; only bits that are new at a node go on.
    """
    places = written(_places(starts))
    edges = written(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    new = written(places.groupBy(F.col("start").alias("id"), "block").agg(F.bit_or("bit").alias("mask")).withColumn("hops", F.lit(0)))
    seen, found = written(new.drop("hops")), [new]
    while not new.isEmpty():
        ahead = new.select(F.col("id").alias("src"), "block", "mask").join(edges, "src").groupBy(F.col("dst").alias("id"), "block").agg(F.bit_or("mask").alias("ahead"))
        fresh = F.col("ahead").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long"))))
        new = written(ahead.join(seen, ["id", "block"], "left").select("id", "block", fresh.alias("mask"), F.lit(len(found)).alias("hops")).filter("mask <> 0"))
        found.append(new)
        more = written(seen.unionByName(new.drop("hops")).groupBy("id", "block").agg(F.bit_or("mask").alias("mask")))
        removed(seen)
        seen = more
    removed(seen, edges)
    return places, reduce(DataFrame.unionByName, found)


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(src, dst, hops)``: every node that each start reaches, itself at 0 hops."""
    places, found = search(edges, starts)
    return found.join(places, "block").filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).select(F.col("start").alias("src"), F.col("id").alias("dst"), "hops")


def reachable(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Answers for ``pairs(src, dst)`` in the one graph of ``nodes(id, uncertain)``: ``status`` as for small graphs, and ``hops`` where it is yes."""
    known = nodes.select("id").distinct()
    places, found = search(edges, pairs.select(F.col("src").alias("id")).join(known, "id", "left_semi"))
    complete = nodes.filter("uncertain").isEmpty()
    here = known.withColumn("_known", F.lit(True))
    asked = pairs.select("src", "dst").distinct().join(places.withColumnRenamed("start", "src"), "src", "left").join(here.withColumnRenamed("id", "dst"), "dst", "left")
    # A node has one row a distance at most in a block; the one that holds the start's bit is the answer.
    hits = asked.filter("_known AND block IS NOT NULL").join(found.withColumnRenamed("id", "dst"), ["dst", "block"]).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("src", "dst", "hops")
    answered = asked.join(hits, ["src", "dst"], "left")
    valid = F.col("block").isNotNull() & F.col("_known").isNotNull()
    return answered.select("src", "dst", status(F.col("hops").isNotNull(), F.lit(complete), valid).alias("status"), "hops")


# -- trees and their nearest common ancestors

#: Ancestors that a tree's row holds; what lies further up is looked up from the last of them.
NEAR = 128


def _tree(parents: DataFrame) -> tuple[DataFrame, int]:
    """``(graph, id, depth, path)`` of ``parents(graph, id, parent)``, null at a root, and the greatest depth.

    ``path`` has the node and the nearest ancestors upwards, NEAR at most.  Pointers double
    their reach each round, and with them what is known of the way up.
    """
    now = written(parents.select("graph", "id", F.col("parent").alias("_to"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.array("id").alias("path")))
    while not now.filter("_to IS NOT NULL").isEmpty():
        ahead = now.select("graph", F.col("id").alias("_to"), F.col("_to").alias("_next"), F.col("depth").alias("_more"), F.col("path").alias("_way"))
        way = F.slice(F.concat("path", F.coalesce("_way", F.array().cast(now.schema["path"].dataType))), 1, NEAR)
        nxt = written(now.join(ahead, ["graph", "_to"], "left").select("graph", "id", F.col("_next").alias("_to"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), way.alias("path")))
        removed(now)
        now = nxt
    return now.select("graph", "id", "depth", "path"), now.agg(F.max("depth")).first()[0] or 0


def _at(rows: DataFrame, tree: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``<name>_depth`` and ``<name>_path`` of the node in column ``name``."""
    return rows.join(tree.select("graph", F.col("id").alias(name), F.col("depth").alias(f"{name}_depth"), F.col("path").alias(f"{name}_path")), ["graph", name], "left")


def ancestor(pairs: DataFrame, tree: DataFrame, deepest: int) -> DataFrame:
    """``pairs(graph, above, below)`` with ``is``: whether above is below itself or on its way to the root; null where either is in no tree."""
    rows = pairs.select("graph", "above", "below", F.col("below").alias("_x"))
    depth = tree.select("graph", F.col("id").alias("above"), F.col("depth").alias("_goal"))
    gap = F.col("_x_depth") - F.col("_goal")
    is_ = F.when(gap < 0, F.lit(False)).otherwise(F.get("_x_path", gap) == F.col("above"))
    answers = []
    while True:
        looked = _at(rows, tree, "_x").join(depth, ["graph", "above"], "left")
        answers.append(looked.filter(F.coalesce(gap < NEAR, F.lit(True))).select("graph", "above", "below", is_.alias("is")))
        if deepest <= (NEAR - 1) * len(answers):
            return reduce(DataFrame.unionByName, answers)
        rows = written(looked.filter(gap >= NEAR).select("graph", "above", "below", F.element_at("_x_path", -1).alias("_x")))


def nearest_common(pairs: DataFrame, tree: DataFrame, deepest: int) -> DataFrame:
    """``pairs(graph, id, a, b)`` with ``nca`` and ``nca_depth``, for a and b of one tree."""
    rows = pairs.select("graph", "id", F.col("a").alias("_x"), F.col("b").alias("_y"))
    answers = []
    while True:
        looked = _at(_at(rows, tree, "_x"), tree, "_y")
        low = F.col("_x_depth") >= F.col("_y_depth")
        side = lambda k, deep: F.when(low if deep else ~low, F.col(f"_x{k}")).otherwise(F.col(f"_y{k}"))
        looked = looked.select("graph", "id", *(side(k, deep).alias(f"_{name}{k}") for name, deep in (("p", True), ("q", False)) for k in ("", "_depth", "_path")))
        gap = F.col("_p_depth") - F.col("_q_depth")
        met = F.filter(F.transform("_q_path", lambda v, i: F.when(v == F.get("_p_path", gap + i), F.struct(v.alias("at"), i.alias("up")))), lambda x: x.isNotNull())
        looked = looked.withColumn("_met", F.get(met, F.lit(0)))
        answers.append(looked.filter("_met IS NOT NULL").select("graph", "id", F.col("_met.at").alias("nca"), (F.col("_q_depth") - F.col("_met.up")).alias("nca_depth")))
        if deepest <= (NEAR - 1) * len(answers):
            return reduce(DataFrame.unionByName, answers)
        # Nothing in common so far: the deeper one goes up, and the other to the same depth where it is not there yet.
        rows = written(looked.filter("_met IS NULL").select("graph", "id", F.element_at("_p_path", -1).alias("_x"), F.coalesce(F.get("_q_path", NEAR - 1 - gap), "_q").alias("_y")))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, answers)


#: Rounds of a search after which what it knows is put together, and graphs that are done are put aside.
TOGETHER = 8


def _climbed(parents: DataFrame) -> DataFrame:
    """``parents(graph, id, parent)`` with ``root``, the end of the way up, by pointers that double their reach."""
    now = written(parents.select("graph", "id", "parent", F.col("parent").alias("_to"), F.coalesce("parent", "id").alias("root")))
    while not now.filter("_to IS NOT NULL").isEmpty():
        ahead = now.select("graph", F.col("id").alias("_to"), F.col("_to").alias("_next"), F.col("root").alias("_root"))
        nxt = written(now.join(ahead, ["graph", "_to"], "left").select("graph", "id", "parent", F.col("_next").alias("_to"), F.coalesce("_root", "root").alias("root")))
        removed(now)
        now = nxt
    return now.select("graph", "id", "parent", "root")


def _first_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph, id, parent)``: a tree of what each graph's entry reaches.

    A node that has a predecessor with a smaller id hangs on the smallest; what hangs on the entry in this
    way, however long, is known after a logarithmic number of rounds.  The rest is found from there, a step a round.
    """
    entry = written(nodes.filter("entry").groupBy("graph").agg(F.min("id").alias("_entry")))
    ids = edges.select("graph", F.col("src").alias("id")).unionByName(edges.select("graph", F.col("dst").alias("id"))).unionByName(entry.select("graph", F.col("_entry").alias("id"))).distinct()
    least = edges.filter("src < dst").groupBy("graph", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    hung = ids.join(entry, "graph").join(least, ["graph", "id"], "left").select("graph", "id", F.when(F.col("id") != F.col("_entry"), F.col("parent")).alias("parent"))
    climbed = _climbed(hung)
    new = written(climbed.join(entry, "graph").filter("root = _entry").select("graph", "id", "parent"))
    active, done, live = [new], [], edges
    while not new.isEmpty():
        known = reduce(DataFrame.unionByName, active).select("graph", "id")
        ahead = new.select("graph", F.col("id").alias("src")).join(live, ["graph", "src"]).groupBy("graph", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = written(ahead.join(known, ["graph", "id"], "left_anti").select("graph", "id", "parent"))
        active.append(new)
        if len(active) > TOGETHER:
            graphs, all_ = written(new.select("graph").distinct()), reduce(DataFrame.unionByName, active)
            kept, rest = written(all_.join(graphs, "graph", "left_semi")), written(all_.join(graphs, "graph", "left_anti"))
            live = written(live.join(graphs, "graph", "left_semi"))
            active, done = [kept], [*done, rest]
    return written(reduce(DataFrame.unionByName, [*done, *active]))


def dominator_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph, id, idom, depth)`` of all nodes that the entry reaches: the immediate dominator, null at the entry.

    A fixpoint: from any tree of reached nodes, the parent of a node moves up to the nearest
    common ancestor of its present parent and each of its predecessors, for all nodes of all
    graphs at once.  A dominator of a node stays above it throughout, and once no edge moves a
    parent, every parent dominates its children.  Only edges whose target's parent is not above
    their source are looked at further.
    """
    own = written(edges.select("graph", "src", "dst").filter("src <> dst").distinct())
    tree = _first_tree(nodes, own)
    reached_ = tree.select("graph", "id")
    # Edges from what is never reached say nothing, nor do those back into the entry.
    live = written(own.join(reached_.withColumnRenamed("id", "src"), ["graph", "src"], "left_semi").join(tree.filter("parent IS NOT NULL").select("graph", F.col("id").alias("dst")), ["graph", "dst"], "left_semi"))
    removed(own)
    while True:
        ways, deepest = _tree(tree)
        over = live.join(tree.select("graph", F.col("id").alias("dst"), F.col("parent").alias("above")), ["graph", "dst"])
        apart = ancestor(over.select("graph", "above", F.col("src").alias("below")).distinct(), ways, deepest).filter("NOT is")
        wrong = over.join(apart.select("graph", "above", F.col("below").alias("src")), ["graph", "above", "src"], "left_semi").select("graph", F.col("dst").alias("id"), F.col("above").alias("a"), F.col("src").alias("b"))
        wrong = written(wrong)
        if wrong.isEmpty():
            removed(wrong, live)
            return tree.join(ways.select("graph", "id", "depth"), ["graph", "id"]).select("graph", "id", F.col("parent").alias("idom"), "depth")
        moved = nearest_common(wrong, ways, deepest).groupBy("graph", "id").agg(F.min_by("nca", "nca_depth").alias("_to"))
        nxt = written(tree.join(moved, ["graph", "id"], "left").select("graph", "id", F.coalesce("_to", "parent").alias("parent")))
        removed(wrong, tree)
        tree = nxt


def dominates(pairs: DataFrame, tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Answers for ``pairs(graph, dominator, target)`` from the one tree of dominator_tree().

    As for walks around a dominator: a target that no path from the entry reaches is dominated by every
    node, which is known only where the graph is complete; else an answer of yes needs a complete graph,
    unless the dominator is the entry or the target.
    """
    ways, deepest = _tree(tree.withColumnRenamed("idom", "parent"))
    known = nodes.groupBy("graph", "id").agg(F.max("entry").alias("_entry"))
    whole = nodes.groupBy("graph").agg((F.count_if("uncertain") == 0).alias("_complete"))
    asked = pairs.select("graph", "dominator", "target").distinct()
    q = asked.join(known.select("graph", F.col("id").alias("dominator"), F.col("_entry").alias("_d")), ["graph", "dominator"], "left").join(known.select("graph", F.col("id").alias("target"), F.lit(True).alias("_t")), ["graph", "target"], "left").join(whole, "graph", "left")
    is_above = ancestor(asked.select("graph", F.col("dominator").alias("above"), F.col("target").alias("below")), ways, deepest).select("graph", F.col("above").alias("dominator"), F.col("below").alias("target"), "is")
    live = tree.select("graph", F.col("id").alias("target"), F.lit(True).alias("_live"))
    q = q.join(is_above, ["graph", "dominator", "target"], "left").join(live, ["graph", "target"], "left")
    trivial = F.col("_d") | (F.col("dominator") == F.col("target"))
    passed = ~F.coalesce("_live", F.lit(False)) | F.coalesce("is", F.lit(False))
    answer = F.when(F.col("_d").isNull() | F.col("_t").isNull(), "invalid").when(trivial, "yes").when(~passed, "no").when(F.col("_complete"), "yes").otherwise("unknown")
    return q.select("graph", "dominator", "target", answer.alias("status"))


# -- classes of equals


def components(pairs: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of ``pairs(a, b)``: the smallest id of its class.

    Each round links every node to the smallest of its neighbourhood, first downwards to larger
    neighbours and then upwards, so that paths shrink to stars in a logarithmic number of rounds.
    """
    now = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        down = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct())
        low = down.groupBy("a").agg(F.min("b").alias("_m"))
        up = down.join(low, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        nxt = written(up.unionByName(low.select("a", F.col("_m").alias("b"))).distinct())
        removed(now, down)
        now = nxt
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
