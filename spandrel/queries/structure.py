"""Graphs, classes and windows made from whole tables: searches in rounds, fixpoints and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bounded_paths, equalities, large_graph, open_windows, sketches, spans, variants
from .common import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SQL_LINE = ", ".join(_LINE)


@query(f"""WITH RECURSIVE lines AS (SELECT l_partkey AS src, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_SQL_LINE}, l_returnflag) AS dst FROM lineitem),
edges AS (SELECT DISTINCT src, dst FROM lines WHERE l_returnflag = 'R' AND dst IS NOT NULL AND src <> dst),
starts AS (SELECT p_brand, min(p_partkey) AS s FROM part GROUP BY p_brand),
r(s, n, h) USING KEY (s, n) AS (SELECT s, s, 0 FROM starts UNION SELECT r.s, e.dst, min(r.h) + 1 FROM r JOIN edges e ON e.src = r.n LEFT JOIN recurring.r k ON k.s = r.s AND k.n = e.dst WHERE k.n IS NULL GROUP BY r.s, e.dst)
SELECT DISTINCT s.s AS src, p_partkey AS dst, CASE WHEN r.h IS NULL THEN 'no' ELSE 'yes' END AS status, r.h AS hops FROM starts s JOIN part USING (p_brand) LEFT JOIN r ON r.s = s.s AND r.n = p_partkey""")
def large_reachability(spark, d):
    """One graph of all parts: a returned line leads to the next line of its order.  Which parts of its brand a brand's first part reaches, and in how many steps."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *_LINE)
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_LINE, "l_returnflag"))
    edges = lines.select(F.col("l_partkey").alias("src"), "l_returnflag", nxt.alias("dst")).filter("l_returnflag = 'R'").select("src", "dst")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    starts = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("src"))
    pairs = parts.join(starts, "p_brand").select("src", F.col("p_partkey").alias("dst"))
    return large_graph.reachable(pairs, edges, parts.select(F.col("p_partkey").alias("id"), F.lit(False).alias("uncertain")))


def _conversation(spark, d):
    """A node a turn; a turn leads to the next one, to the next of its role, and an assistant's also past its answer."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("id"), "role").distinct()
    order = Window.partitionBy("graph").orderBy("id")
    per_role = Window.partitionBy("graph", "role").orderBy("id")
    ahead = turns.select("graph", F.col("id").alias("src"), F.array(F.lead("id").over(order), F.lead("id").over(per_role), F.when(F.col("role") == "assistant", F.lead("id", 2).over(order))).alias("to"), F.row_number().over(order).alias("n"), F.lead("id").over(order).isNull().alias("exit"))
    edges = ahead.select("graph", "src", F.explode("to").alias("dst")).filter("dst IS NOT NULL").distinct()
    nodes = ahead.select("graph", F.col("src").alias("id"), (F.col("n") == 1).alias("entry"), "exit", F.lit(False).alias("uncertain"))
    return nodes, edges


_TURNS = """turns AS (SELECT DISTINCT conv_id AS graph, turn AS id, role FROM conversations),
ahead AS (SELECT graph, id, role, row_number() OVER w AS n, lead(id) OVER w AS a, lead(id) OVER (PARTITION BY graph, role ORDER BY id) AS b, CASE WHEN role = 'assistant' THEN lead(id, 2) OVER w END AS c FROM turns WINDOW w AS (PARTITION BY graph ORDER BY id)),
edges AS (SELECT DISTINCT graph, id AS src, dst FROM (SELECT graph, id, unnest([a, b, c]) AS dst FROM ahead) WHERE dst IS NOT NULL),
entries AS (SELECT graph, id AS s FROM ahead WHERE n = 1)"""


@query(f"""WITH RECURSIVE {_TURNS}, live AS (SELECT graph, s AS id FROM entries UNION SELECT e.graph, e.dst FROM live l JOIN edges e ON e.graph = l.graph AND e.src = l.id),
walk AS (SELECT l.graph, l.id AS d, s AS at FROM live l JOIN entries USING (graph) WHERE l.id <> s UNION SELECT w.graph, w.d, e.dst FROM walk w JOIN edges e ON e.graph = w.graph AND e.src = w.at AND e.dst <> w.d),
above AS (SELECT a.graph, a.id AS d, b.id AS t FROM live a JOIN live b ON a.graph = b.graph AND a.id <> b.id LEFT JOIN walk w ON w.graph = a.graph AND w.d = a.id AND w.at = b.id WHERE w.at IS NULL),
n AS (SELECT graph, t, count(*) AS k FROM above GROUP BY ALL),
i AS (SELECT a.graph, a.t, max_by(a.d, coalesce(n.k, 0)) AS idom, count(*) AS dominators FROM above a LEFT JOIN n ON n.graph = a.graph AND n.t = a.d GROUP BY a.graph, a.t)
SELECT l.graph, l.id, i.idom, coalesce(i.dominators, 0) AS dominators FROM live l LEFT JOIN i ON i.graph = l.graph AND i.t = l.id""")
def immediate_dominators(spark, d):
    """The dominator tree of every conversation's graph; a node's depth is the number of its strict dominators."""
    nodes, edges = _conversation(spark, d)
    return large_graph.dominator_tree(nodes, edges).select("graph", "id", "idom", F.col("depth").alias("dominators"))


_BUDGET = 24


@query(f"""WITH RECURSIVE {_TURNS}, walk AS (SELECT graph, [s] AS path FROM entries UNION ALL SELECT w.graph, list_append(path, e.dst) FROM walk w JOIN edges e ON e.graph = w.graph AND e.src = path[-1]),
v AS (SELECT graph, count(*) AS visits FROM walk GROUP BY graph), ends AS (SELECT graph, id FROM ahead WHERE a IS NULL)
SELECT v.graph, 'complete' AS status, visits, array_to_string(path, '>') AS path FROM v JOIN walk w USING (graph) JOIN ends x ON x.graph = v.graph AND x.id = path[-1] WHERE visits <= {_BUDGET}
UNION ALL SELECT graph, 'unknown', NULL, NULL FROM v WHERE visits > {_BUDGET}""")
def bounded_path_enumeration(spark, d):
    """Every way through a conversation's graph, within a budget of visits; beyond it the conversation's answer is unknown."""
    nodes, edges = _conversation(spark, d)
    answers, found = bounded_paths.paths(nodes, edges, _BUDGET)
    return answers.join(found, "graph", "left").select("graph", "status", "visits", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE lines AS (SELECT year(l_shipdate) AS scope, 'p' || l_partkey AS part, l_returnflag, lead('p' || l_partkey) OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY {_SQL_LINE}, l_returnflag, l_orderkey) AS mate,
  lead('p' || l_partkey) OVER (PARTITION BY l_orderkey, year(l_shipdate) ORDER BY {_SQL_LINE}, l_returnflag) AS nxt, lead(l_returnflag) OVER (PARTITION BY l_orderkey, year(l_shipdate) ORDER BY {_SQL_LINE}, l_returnflag) AS flag FROM lineitem),
eq AS (SELECT DISTINCT scope, part AS a, mate AS b FROM lines WHERE mate IS NOT NULL), ne AS (SELECT DISTINCT scope, part AS a, nxt AS b FROM lines WHERE nxt IS NOT NULL AND flag <> l_returnflag),
sides AS (SELECT scope, a, b FROM eq UNION SELECT scope, b, a FROM eq), symbols AS (SELECT scope, a AS x FROM eq UNION SELECT scope, b FROM eq UNION SELECT scope, a FROM ne UNION SELECT scope, b FROM ne),
r(scope, x, m) USING KEY (scope, x) AS (SELECT scope, x, x FROM symbols UNION SELECT e.scope, e.b, min(r.m) FROM r JOIN sides e ON e.scope = r.scope AND e.a = r.x JOIN recurring.r k ON k.scope = e.scope AND k.x = e.b WHERE r.m < k.m GROUP BY e.scope, e.b),
bad AS (SELECT n.scope, a.m AS root, count(*) AS k FROM ne n JOIN r a ON a.scope = n.scope AND a.x = n.a JOIN r b ON b.scope = n.scope AND b.x = n.b WHERE a.m = b.m GROUP BY ALL)
SELECT c.scope, c.m AS root, c.n AS n_symbols, coalesce(k, 0) AS n_contradictions FROM (SELECT scope, m, count(*) AS n FROM r GROUP BY ALL) c LEFT JOIN bad ON bad.scope = c.scope AND bad.root = c.m WHERE n > 1 OR k > 0""")
def equality_classes(spark, d):
    """Parts as symbols, years as scopes: what one supplier ships on one day is equal, neighbours in an order with different return flags differ."""
    lines = table(spark, d, "lineitem").withColumn("scope", F.year("l_shipdate"))
    # Lines of one number and part are alike here, so what else orders a supplier's day changes no fact; each window shuffles its own columns alone.
    day = Window.partitionBy("l_suppkey", "l_shipdate").orderBy("l_linenumber", "l_partkey")
    mates = lines.select("scope", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").withColumn("mate", F.lead("l_partkey").over(day)).filter("mate IS NOT NULL")
    order = Window.partitionBy("l_orderkey", "scope").orderBy(*_LINE, "l_returnflag")
    ahead = lines.select("scope", "l_orderkey", "l_returnflag", *_LINE).withColumns({"nxt": F.lead("l_partkey").over(order), "flag": F.lead("l_returnflag").over(order)}).filter("nxt IS NOT NULL AND flag <> l_returnflag")
    part = lambda key, name: F.concat(F.lit("p"), key).alias(name)
    facts = mates.select("scope", part("l_partkey", "left"), F.lit("==").alias("op"), part("mate", "right")).unionByName(ahead.select("scope", part("l_partkey", "left"), F.lit("!=").alias("op"), part("nxt", "right")))
    return equalities.judged(facts)


_KEY = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, ts, {_KEY} % 8 AS base, CASE WHEN value >= 5 THEN {_KEY} END AS key FROM events),
c AS (SELECT w.event_id, x.event_id AS closed_by, CASE WHEN w.key = x.key THEN 'same' ELSE 'maybe' END AS alias, row_number() OVER (PARTITION BY w.event_id ORDER BY x.ts, x.event_id) AS n
  FROM e w JOIN e x ON x.user_id = w.user_id AND x.base = w.base AND (x.ts, x.event_id) > (w.ts, w.event_id) AND (x.key = w.key OR x.key IS NULL OR w.key IS NULL) WHERE w.event_type = 'view' AND x.event_type = 'purchase')
SELECT e.event_id, closed_by, coalesce(alias, 'open') AS alias FROM e LEFT JOIN c ON c.event_id = e.event_id AND n = 1 WHERE event_type = 'view'""")
def open_window_closings(spark, d):
    """Views as windows and purchases as writes of a user; the key of a row of little value is not known."""
    key = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("scope"), (key % 8).alias("base"), F.when(F.col("value") >= 5, key).alias("key"), F.struct("ts", "event_id").alias("at"))
    windows = rows.filter("event_type = 'view'").select("event_id", "scope", "base", "key", "at")
    writes = rows.filter("event_type = 'purchase'").select("scope", "base", "key", "at", F.col("event_id").alias("id"))
    return open_windows.closed_by(windows, writes, F.date_trunc("day", "at.ts")).select("event_id", "closed_by", "alias")


@query("""WITH l AS (SELECT doc_id, text, i AS line, s, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
t AS (SELECT doc_id, line, j, s, start + coalesce(sum(length(s) + 2) OVER (PARTITION BY doc_id, line ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, line, start, unnest(string_split(s, '. ')) AS s, unnest(range(len(string_split(s, '. ')))) AS j FROM l)),
x AS (SELECT doc_id, 0::BIGINT AS id, 0::BIGINT AS a, length(text)::BIGINT AS b FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1 + line, start::BIGINT, (start + length(s))::BIGINT FROM l
  UNION ALL SELECT doc_id, 1000000 * (1 + line) + j, start::BIGINT, (start + length(s))::BIGINT FROM t),
p AS (SELECT c.doc_id, c.id, count(*) AS depth, arg_min(o.id, (o.b - o.a, -o.id)) AS parent FROM x c JOIN x o ON o.doc_id = c.doc_id AND o.id <> c.id AND o.a < o.b
  AND CASE WHEN c.a = c.b THEN o.a < c.a AND c.b < o.b ELSE o.a <= c.a AND c.b <= o.b AND (o.b - o.a > c.b - c.a OR o.id < c.id) END GROUP BY ALL)
SELECT x.doc_id, x.id, a AS start, b AS "end", coalesce(depth, 0) AS depth, parent, false AS tangled FROM x LEFT JOIN p USING (doc_id, id)""")
def nested_spans(spark, d):
    """Documents, their lines and the sentences of each line as spans, each with the tightest one around it."""
    pieces = F.transform(F.split("text", "\n", -1), lambda s: F.struct(F.length(s).alias("n"), F.transform(F.split(s, "[.] ", -1), lambda t: F.length(t)).alias("parts")))
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), pieces.alias("lines")).filter("n IS NOT NULL")
    # Places of lines, and of sentences within a line, by running sums over the lengths alone.
    starts = lambda x, gap: F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + gap)))
    lines = docs.select("doc_id", F.posexplode("lines").alias("line", "l")).select("doc_id", "line", "l.*")
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    parts = lines.select("doc_id", "line", "start", F.posexplode(F.arrays_zip("parts", F.slice(starts(F.col("parts"), 2), 1, F.size("parts")).alias("at"))).alias("j", "p"))
    span = lambda rows, i, start, n: rows.select(F.col("doc_id").alias("doc"), i.cast("long").alias("id"), start.cast("long").alias("start"), (start + n).cast("long").alias("end"))
    spans_ = span(docs, F.lit(0), F.lit(0), F.col("n")).unionByName(span(lines, 1 + F.col("line"), F.col("start"), F.col("n"))).unionByName(span(parts, 1_000_000 * (1 + F.col("line")) + F.col("j"), F.col("start") + F.col("p.at"), F.col("p.parts")))
    return spans.nested(spans_).withColumnRenamed("doc", "doc_id")


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS i FROM conversations),
n AS (SELECT conv_id, 0 AS node, NULL AS parent, 0 AS depth, '$' AS name, 'object' AS kind, NULL AS scalar FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT DISTINCT conv_id, 1, 0, 1, 'conv', 'scalar', CAST(conv_id AS VARCHAR) FROM t
  UNION ALL SELECT DISTINCT conv_id, 2, 0, 1, 'turns', 'array', NULL FROM t UNION ALL SELECT conv_id, 3 + 5 * i, 2, 2, '[' || i || ']', 'object', NULL FROM t UNION ALL SELECT conv_id, 4 + 5 * i, 3 + 5 * i, 3, 'said', 'object', NULL FROM t
  UNION ALL SELECT conv_id, 5 + 5 * i, 4 + 5 * i, 4, 'chars', 'scalar', CAST(chars AS VARCHAR) FROM t UNION ALL SELECT conv_id, 6 + 5 * i, 4 + 5 * i, 4, 'role', 'scalar', role FROM t UNION ALL SELECT conv_id, 7 + 5 * i, 3 + 5 * i, 3, 'turn', 'scalar', CAST(turn AS VARCHAR) FROM t)
SELECT * FROM n""")
def variant_walk(spark, d):
    """Each conversation as one nested document, and all of its nodes in pre-order."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("chars")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    turn = F.transform("t", lambda x: F.struct(F.struct(x["chars"].alias("chars"), x["role"].alias("role")).alias("said"), x["turn"].alias("turn")))
    return variants.walk(listed.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), turn.alias("turns"))).alias("json")), "json").select("conv_id", "node", "parent", "depth", "name", "kind", "scalar")


_SHARES = [0.5, 0.95, 0.99]


@query("""SELECT lang, share, count(n_chars) AS n, true AS within FROM documents, (VALUES (0.5::DOUBLE), (0.95), (0.99)) t(share) GROUP BY lang, share HAVING count(n_chars) > 0""")
def sketched_quantiles(spark, d):
    """Lengths of documents: a sketch a language and source, merged by language; whether each quantile's exact rank is within 2 % of its share."""
    docs = table(spark, d, "documents").select("lang", "source", "n_chars")
    found = sketches.quantiles(sketches.merged(sketches.sketched(docs, ["lang", "source"], F.col("n_chars")), ["lang"]), ["lang"], _SHARES)
    return sketches.rank_errors(docs, ["lang"], F.col("n_chars"), found).select("lang", "share", "n", (F.col("error") <= 0.02).alias("within"))
