"""Every path from a graph's entry to its exits, or an abstention where a budget of visits is met.

``nodes(graph, id, entry, exit)`` and ``edges(graph, src, dst)``.  All graphs grow their paths together, a
step a round, as rows with the nodes behind them.  A visit is a node put at the end of a
path; what a step would visit is summed from out-degrees before it is taken, so no graph
ever holds more rows than its budget.  A path that meets a node again could go on for
ever, so its graph will meet any budget and abstains at once.

Edge cases: a graph without an entry has no paths and no row; repeated nodes and edges count
once; edges with an end that is no node are ignored; of several entries each starts a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import removed, written

MOST_VISITS = 4096


def paths(nodes: DataFrame, edges: DataFrame, budget: int = MOST_VISITS) -> tuple[DataFrame, DataFrame]:
    """``(graph, status, visits)``, ``complete`` or ``unknown`` with null visits; and ``(graph, path)`` of the complete ones."""
    ids = nodes.groupBy("graph", "id").agg(F.max("entry").alias("entry"), F.max("exit").alias("exit"))
    heads = ids.select("graph", F.col("id").alias("dst"), F.col("exit").alias("_exit"))
    steps = edges.select("graph", "src", "dst").distinct().join(heads, ["graph", "dst"]).groupBy("graph", "src").agg(F.collect_list(F.struct("dst", "_exit")).alias("_next"))
    steps = written(steps)
    first = ids.filter("entry").select("graph", F.array("id").alias("path"), F.col("exit").alias("_exit"))
    now = written(first.join(steps.withColumnRenamed("src", "_at").withColumn("_n", F.size("_next")), [first["graph"] == steps["graph"], F.element_at("path", -1) == F.col("_at")], "left").select(first["graph"], "path", "_exit", "_next", F.coalesce("_n", F.lit(0)).alias("_n")))
    spent = written(now.groupBy("graph").agg(F.count("*").alias("visits"), F.sum("_n").alias("_ahead"), F.lit(False).alias("_lost")))
    ends = [written(now.filter("_exit").select("graph", "path"))]
    while True:
        # A node met again, or more visits ahead than are left, loses the graph.
        again = now.filter(F.exists(F.coalesce("_next", F.array()), lambda x: F.array_contains("path", x["dst"]))).select("graph").distinct().withColumn("_again", F.lit(True))
        judged = written(spent.join(again, "graph", "left").select("graph", "visits", "_ahead", (F.col("_lost") | F.coalesce("_again", F.lit(False)) | (F.col("visits") + F.col("_ahead") > budget)).alias("_lost")))
        going = judged.filter("NOT _lost AND _ahead > 0").select("graph")
        grown = now.join(going, "graph", "left_semi").select("graph", "path", F.explode("_next").alias("_to")).select("graph", F.concat("path", F.array("_to.dst")).alias("path"), F.col("_to._exit").alias("_exit"))
        behind = steps.select(F.col("graph").alias("_graph"), F.col("src").alias("_at"), "_next")
        new = written(grown.join(behind, (F.col("graph") == F.col("_graph")) & (F.element_at("path", -1) == F.col("_at")), "left").select("graph", "path", "_exit", "_next", F.coalesce(F.size("_next"), F.lit(0)).alias("_n")))
        if new.isEmpty():
            break
        ends.append(written(new.filter("_exit").select("graph", "path")))
        count = new.groupBy("graph").agg(F.count("*").alias("_more"), F.sum("_n").alias("_next_ahead"))
        nxt = written(judged.join(count, "graph", "left").select("graph", (F.col("visits") + F.coalesce("_more", F.lit(0))).alias("visits"), F.coalesce("_next_ahead", F.lit(0)).alias("_ahead"), "_lost"))
        removed(now, spent, judged)
        now, spent = new, nxt
    answer = judged.select("graph", F.when(F.col("_lost"), "unknown").otherwise("complete").alias("status"), F.when(~F.col("_lost"), F.col("visits")).alias("visits"))
    return answer, reduce(DataFrame.unionByName, ends).join(judged.filter("NOT _lost").select("graph"), "graph", "left_semi")
