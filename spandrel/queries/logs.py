"""Ordered checks over the event log and graph queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import paths_sql as P
from ..streaming import calls
from .common import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_BY, _ORDER = ["user_id"], ["ts", "event_id"]


@query("""SELECT event_id, user_id, coalesce(max(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events""")
def call_seen_before(spark, d):
    return P.seen_before(table(spark, d, "events"), _BY, _ORDER, F.col("event_type") == "error").select("event_id", "user_id", "seen")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT w.user_id, w.event_id, w.n, coalesce((SELECT max(n) FROM e p WHERE p.user_id = w.user_id AND p.event_type = 'purchase' AND p.n < w.n), 0) AS since FROM e w WHERE w.event_type = 'purchase')
SELECT user_id, event_id FROM w WHERE EXISTS (SELECT 1 FROM e c JOIN e v ON v.user_id = c.user_id WHERE c.user_id = w.user_id AND c.event_type = 'click' AND v.event_type = 'view' AND since < v.n AND v.n < c.n AND c.n < w.n)""")
def check_call_write(spark, d):
    is_ = lambda t: F.col("event_type") == t
    return P.check_call_write(table(spark, d, "events"), _BY, _ORDER, is_("view"), is_("click"), is_("purchase")).select("user_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events WHERE event_type IN ('error', 'purchase'))
SELECT user_id, event_id FROM e WHERE event_type = 'error' AND coalesce(following, 'error') <> 'purchase'""")
def unhandled_call(spark, d):
    return P.unhandled(table(spark, d, "events"), _BY, _ORDER, F.col("event_type") == "error", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND (s.ts, s.event_id) < (p.ts, p.event_id))""")
def auth_guard_missing(spark, d):
    return P.missing_guard(table(spark, d, "events"), _BY, _ORDER, F.col("event_type") == "purchase", F.col("event_type") == "signup").select("user_id", "event_id")


@query("SELECT event_type, coalesce(following, 'none') AS following, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) GROUP BY ALL")
def next_event_guard(spark, d):
    rows = P.next_is(table(spark, d, "events"), _BY, _ORDER, "event_type", "following")
    return rows.groupBy("event_type", F.coalesce("following", F.lit("none")).alias("following")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'purchase')) WHERE rn = 1")
def first_match(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase")).select("user_id", "ts", "event_id", "event_type")
    return P.first_match(rows, _BY, _ORDER).select("user_id", "event_id", "event_type")


def _graph(spark, d):
    """A node a turn; a turn leads to the next, and an assistant's turn also to the one after it."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("id"), "role").distinct()
    step = turns.select("graph", F.col("id").alias("src"), F.explode(F.when(F.col("role") == "assistant", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("k"))
    heads = step.select("graph", "src", (F.col("src") + F.col("k")).alias("dst"), F.when(F.col("k") == 1, "next").otherwise("skip").alias("kind"))
    edges = heads.join(turns.select("graph", F.col("id").alias("dst")), ["graph", "dst"], "left_semi").distinct()
    first = turns.groupBy("graph").agg(F.min("id").alias("_first"))
    nodes = turns.groupBy("graph", "id").agg(F.lit(False).alias("uncertain")).join(first, "graph").select("graph", "id", (F.col("id") == F.col("_first")).alias("entry"), "uncertain")
    return nodes, edges.select("graph", "src", "dst", "kind")


_NODES = "nodes AS (SELECT DISTINCT conv_id AS graph, turn AS id, role FROM conversations)"
_EDGES = "edges AS (SELECT DISTINCT a.graph, a.id AS src, b.id AS dst, CASE WHEN b.id = a.id + 1 THEN 'next' ELSE 'skip' END AS kind FROM nodes a JOIN nodes b ON a.graph = b.graph AND (b.id = a.id + 1 OR (b.id = a.id + 2 AND a.role = 'assistant')))"
_CLOSED = "closed AS (SELECT graph, src, dst FROM edges UNION SELECT c.graph, c.src, e.dst FROM closed c JOIN edges e ON c.graph = e.graph AND c.dst = e.src)"


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_CLOSED} SELECT graph, src, dst FROM closed")
def graph_closure(spark, d):
    return G.closure(_graph(spark, d)[1])


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_CLOSED}
SELECT a.graph, a.src, a.dst, CASE WHEN n.id IS NULL THEN 'invalid' WHEN a.src = a.dst OR c.src IS NOT NULL THEN 'yes' ELSE 'no' END AS status
FROM (SELECT DISTINCT graph, id AS src, id + k AS dst FROM nodes, (VALUES (0), (3), (-1)) t(k)) a LEFT JOIN (SELECT DISTINCT graph, id FROM nodes) n ON n.graph = a.graph AND n.id = a.dst
LEFT JOIN closed c ON c.graph = a.graph AND c.src = a.src AND c.dst = a.dst""")
def reachability(spark, d):
    nodes, edges = _graph(spark, d)
    pairs = nodes.select("graph", F.col("id").alias("src"), F.explode(F.array(F.col("id"), F.col("id") + 3, F.col("id") - 1)).alias("dst"))
    return G.reachable(pairs, edges, nodes)


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_CLOSED}, u AS (SELECT DISTINCT graph FROM nodes WHERE role = 'system'),
q AS (SELECT DISTINCT CASE WHEN id % 5 = 4 THEN -1 - graph ELSE graph END AS graph, CASE WHEN id % 3 = 2 THEN id + 100 ELSE id END AS src, id + k AS dst FROM nodes, (VALUES (2), (-1)) t(k))
SELECT q.graph, q.src, q.dst, CASE WHEN s.id IS NULL OR t.id IS NULL THEN 'invalid' WHEN c.src IS NOT NULL THEN 'yes' WHEN u.graph IS NULL THEN 'no' ELSE 'unknown' END AS status,
  CASE WHEN q.graph < 0 THEN 'no such graph' WHEN s.id IS NULL AND t.id IS NULL THEN 'no such nodes' WHEN s.id IS NULL THEN 'no such source' WHEN t.id IS NULL THEN 'no such target' WHEN c.src IS NULL AND u.graph IS NOT NULL THEN 'the graph is not complete' END AS reason
FROM q LEFT JOIN (SELECT DISTINCT graph, id FROM nodes) s ON s.graph = q.graph AND s.id = q.src LEFT JOIN (SELECT DISTINCT graph, id FROM nodes) t ON t.graph = q.graph AND t.id = q.dst
LEFT JOIN closed c ON c.graph = q.graph AND c.src = q.src AND c.dst = q.dst LEFT JOIN u ON u.graph = q.graph""")
def reachability_reasons(spark, d):
    """Why an answer is invalid or unknown; conversations with a system turn count as not complete."""
    nodes, edges = _graph(spark, d)
    loose = table(spark, d, "conversations").filter("role = 'system'").select(F.col("conv_id").alias("graph")).distinct().withColumn("_loose", F.lit(True))
    nodes = nodes.join(loose, "graph", "left").withColumn("uncertain", F.coalesce("_loose", F.lit(False))).drop("_loose")
    id_ = F.col("id")
    pairs = nodes.select(F.when(id_ % 5 == 4, -1 - F.col("graph")).otherwise(F.col("graph")).alias("graph"), F.when(id_ % 3 == 2, id_ + 100).otherwise(id_).alias("src"), F.explode(F.array(id_ + 2, id_ - 1)).alias("dst")).distinct()
    return G.with_reasons(G.reachable(pairs, edges, nodes), nodes)


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_CLOSED}
SELECT a.graph, a.src, a.dst, CASE WHEN n.id IS NULL THEN 'invalid' WHEN c.src IS NOT NULL THEN 'yes' ELSE 'no' END AS status
FROM (SELECT DISTINCT graph, id AS src, id + k AS dst FROM nodes, (VALUES (0), (1), (-1)) t(k)) a LEFT JOIN (SELECT DISTINCT graph, id FROM nodes) n ON n.graph = a.graph AND n.id = a.dst
LEFT JOIN closed c ON c.graph = a.graph AND c.src = a.src AND c.dst = a.dst""")
def ordered_pairs(spark, d):
    nodes, edges = _graph(spark, d)
    pairs = nodes.select("graph", F.col("id").alias("src"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") - 1)).alias("dst"))
    return G.ordered(pairs, edges, nodes)


@query(f"WITH {_NODES} SELECT graph, CASE WHEN bool_and(src + 1 = dst) THEN 'yes' ELSE 'no' END AS status FROM (SELECT graph, id AS src, coalesce(lead(id) OVER (PARTITION BY graph ORDER BY id), id + 1) AS dst FROM (SELECT DISTINCT graph, id FROM nodes)) GROUP BY graph")
def ordered_sequence(spark, d):
    nodes, edges = _graph(spark, d)
    sequences = nodes.groupBy("graph").agg(F.sort_array(F.collect_set("id")).alias("nodes")).withColumn("seq", F.lit(0))
    return G.ordered_sequences(sequences, edges, nodes).select("graph", "status")


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_CLOSED}, last AS (SELECT graph, max(id) AS target FROM nodes GROUP BY graph),
q AS (SELECT e.graph, e.src AS branch, e.kind, e.dst, target FROM edges e JOIN last USING (graph))
SELECT q.graph, branch, kind, target, CASE WHEN q.dst = target OR c.src IS NOT NULL THEN 'yes' ELSE 'no' END AS status FROM q LEFT JOIN closed c ON c.graph = q.graph AND c.src = q.dst AND c.dst = target""")
def branch_reachability(spark, d):
    nodes, edges = _graph(spark, d)
    last = nodes.groupBy("graph").agg(F.max("id").alias("target"))
    queries = edges.select("graph", F.col("src").alias("branch"), "kind").join(last, "graph")
    return G.branch_reachable(queries, edges, nodes)


@query(f"""WITH RECURSIVE {_NODES}, {_EDGES}, start AS (SELECT graph, min(id) AS s, max(id) AS t FROM nodes GROUP BY graph),
q AS (SELECT DISTINCT graph, id AS d, s, t FROM nodes JOIN start USING (graph)),
walk AS (SELECT graph, d, s AS at FROM q WHERE d <> s UNION SELECT w.graph, w.d, e.dst FROM walk w JOIN edges e ON e.graph = w.graph AND e.src = w.at AND e.dst <> w.d)
SELECT q.graph, q.d AS dominator, q.t AS target, CASE WHEN q.d IN (q.s, q.t) THEN 'yes' WHEN w.at IS NOT NULL THEN 'no' ELSE 'yes' END AS status FROM q LEFT JOIN walk w ON w.graph = q.graph AND w.d = q.d AND w.at = q.t""")
def dominators(spark, d):
    nodes, edges = _graph(spark, d)
    last = nodes.groupBy("graph").agg(F.max("id").alias("target"))
    return G.dominates(nodes.select("graph", F.col("id").alias("dominator")).join(last, "graph"), edges, nodes)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 5 GROUP BY ALL")
def json_probe(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k")).filter("k >= 5")
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH o AS (SELECT *, CASE WHEN lag(event_type) OVER w IN ('purchase', 'error') OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o),
e AS (SELECT user_id, session, max_by(event_type, (ts, event_id)) AS kind, max_by(event_id, (ts, event_id)) AS ended_by FROM s GROUP BY ALL)
SELECT c.user_id, c.event_id, CASE (SELECT min_by(event_type, (ts, event_id)) FROM s n WHERE n.user_id = c.user_id AND n.session = c.session AND (n.ts, n.event_id) > (c.ts, c.event_id) AND n.event_type IN ('click', 'signup')) WHEN 'click' THEN 'handled' WHEN 'signup' THEN 'escaped' ELSE 'unhandled' END AS status, ended_by
FROM s c JOIN e USING (user_id, session) WHERE c.event_type = 'view' AND e.kind = 'purchase'""")
def settled_calls(spark, d):
    """Views as calls that a click handles and a signup lets escape, settled by a purchase and discarded by an error or a day without events."""
    return calls.settled(calls_log(table(spark, d, "events")), 86_400).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "status", "ended_by")


def calls_log(events):
    kind = F.create_map(*(F.lit(x) for pair in (("view", calls.CALL), ("click", calls.HANDLER), ("signup", calls.ESCAPE), ("purchase", calls.SUCCESS), ("error", calls.FAILURE)) for x in pair))
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.try_element_at(kind, "event_type").alias("kind"))


@query("""SELECT 'window' AS kind, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_windows(spark, d):
    """An addition: the batch side of the streaming summary."""
    from ..streaming.summary import hourly

    return hourly(table(spark, d, "events")).select(F.lit("window").alias("kind"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
