"""Rule features as two-level aggregations over the tree table: nodes to functions, functions to files.

The quirks of the feature definitions are kept on purpose, as models are trained on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feature names per rule, in the fixed order of the feature vector.
FEATURES = {
    "TXO-001": ("has_origin_comparison", "origin_guard_count", "origin_guards_state_change", "sender_auth_present", "external_call_present", "state_write_present", "branch_count", "unsupported_feature"),
    "REN-001": ("storage_read_count", "external_call_count", "storage_write_count", "post_call_write_matches_read", "checks_effects_interactions", "view_pure_call_only", "state_read_before_call", "unsupported_feature"),
    "ACC-001": ("authority_declared", "authority_write_present", "caller_restriction_present", "literal_address_guard", "unrestricted_authority_write", "two_step_handover_pattern", "public_entry_point_count", "unsupported_feature"),
    "UEC-001": ("low_level_call_count", "delegatecall_count", "result_discarded_count", "result_assigned_unused_count", "result_checked_count", "unhandled_call_reaches_exit", "revert_on_failure_present", "unsupported_feature"),
    "TMP-001": ("has_timestamp_reference", "timestamp_equality_guard", "timestamp_modulo_arithmetic", "timestamp_guards_state_change", "interval_comparison_present", "external_call_present", "state_write_present", "unsupported_feature"),
}

c = F.col
_LOOPS = ("ForStatement", "WhileStatement", "InlineAssembly")
_CALLS_OUT = ("call", "delegatecall", "transfer", "send")


def _type() -> Column:
    return c("node_type")


def _equal() -> Column:
    return (_type() == "BinaryOperation") & c("op").isin("==", "!=")


def _has(*parts: str) -> Column:
    return reduce(lambda a, b: a & b, (F.contains("probe", F.lit(p)) for p in parts))


def _any(x: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0))


def _count(x: Column) -> Column:
    return F.count_if(F.coalesce(x, F.lit(False)))


def _member_of(base: str, member: str) -> Column:
    return (_type() == "MemberAccess") & (c("member") == member) & (c("base") == base)


def _functions(nodes: DataFrame, **columns: Column) -> DataFrame:
    return nodes.filter(c("func").isNotNull()).groupBy("file", "func").agg(*(v.alias(k) for k, v in columns.items()))


def _files(nodes: DataFrame, table: DataFrame, **columns: Column) -> DataFrame:
    """One row for each file, with zeros where it has no function."""
    out = table.groupBy("file").agg(*(v.alias(k) for k, v in columns.items()))
    return nodes.select("file").distinct().join(out, "file", "left").fillna(0)


def txo(nodes: DataFrame) -> DataFrame:
    guard = _equal() & _has('"memberName": "origin"', '"name": "tx"')
    f = _functions(
        nodes, origin=_any(_member_of("tx", "origin")), guards=_count(guard), sender=_any(_member_of("msg", "sender")), calls=_any(c("callee").isin(*_CALLS_OUT)),
        writes=_any(_type() == "Assignment"), branches=_count(_type().isin("IfStatement", "Conditional")), odd=_any(_type().isin(*_LOOPS, "DoWhileStatement")),
    )
    return _files(
        nodes, f, has_origin_comparison=F.max((c("guards") > 0).cast("long")), origin_guard_count=F.sum("guards"), origin_guards_state_change=F.max(c("origin") * F.greatest("writes", "calls")),
        sender_auth_present=F.max("sender"), external_call_present=F.max("calls"), state_write_present=F.max("writes"), branch_count=F.sum("branches"), unsupported_feature=F.max("odd"),
    )


def _state_names(nodes: DataFrame) -> DataFrame:
    return nodes.filter(c("state") & (_type() == "VariableDeclaration")).select("file", "name").distinct()


def ren(nodes: DataFrame) -> DataFrame:
    inside = nodes.filter(c("func").isNotNull() & c("stmt").isNotNull())
    named = inside.join(_state_names(nodes).withColumn("is_state", F.lit(True)), ["file", "name"], "left")
    first = named.groupBy("file", "func").agg(F.min(F.when(c("callee").isin(*_CALLS_OUT), c("stmt"))).alias("call_at"))
    marked = named.join(first, ["file", "func"])
    read = (_type() == "Identifier") & c("is_state")
    early = read & (c("call_at").isNull() | (c("stmt") <= c("call_at")))
    late = read & c("assigned") & (c("stmt") > c("call_at"))
    f = _functions(
        marked, reads=_count(early), calls=_count(c("callee").isin(*_CALLS_OUT)), writes=_count(_type() == "Assignment"), late=_any(late), static=_any(c("callee") == "staticcall"), odd=_any(_type().isin(*_LOOPS)),
    )
    out = _files(
        nodes, f, storage_read_count=F.sum("reads"), external_call_count=F.sum("calls"), storage_write_count=F.sum("writes"),
        # A state variable that is assigned is read as well, as its name occurs.
        post_call_write_matches_read=F.max("late"), _late=F.max("late"), view_pure_call_only=F.max("static"), state_read_before_call=F.max((c("reads") > 0).cast("long")), unsupported_feature=F.max("odd"),
    )
    return out.withColumn("checks_effects_interactions", 1 - c("_late")).drop("_late")


def acc(nodes: DataFrame) -> DataFrame:
    names = _state_names(nodes).withColumn("low", F.lower("name"))
    authority = c("low").contains("owner") | c("low").contains("admin")
    declared = names.groupBy("file").agg(_any(authority).alias("authority_declared"), _any(c("low").contains("pending")).alias("two_step_handover_pattern"), F.collect_set("name").alias("names"))
    builds = nodes.filter((_type() == "FunctionDefinition") & (c("kind") == "constructor")).select("file", c("id").alias("func"))
    marked = nodes.filter(c("func").isNotNull()).join(builds, ["file", "func"], "left_anti").join(names.filter(authority).select("file", "name", F.lit(True).alias("is_authority")), ["file", "name"], "left").join(declared.select("file", "names"), "file", "left")
    caller = _equal() & _has('"memberName": "sender"', '"name": "msg"')
    by_state = caller & F.exists("names", lambda v: F.contains(c("probe"), F.concat(F.lit('"name": "'), v, F.lit('"'))))
    entry = (_type() == "FunctionDefinition") & (c("id") == c("func")) & c("visibility").isin("public", "external")
    f = _functions(
        marked, restricted=_any(caller), by_state=_any(by_state), literal=_any(caller & (_has("0x") | _has("address("))), replaces=_any((_type() == "Identifier") & c("is_authority") & c("assigned")), entry=_any(entry), odd=_any(_type().isin(*_LOOPS)),
    )
    out = _files(
        nodes, f, authority_write_present=F.max("replaces"), caller_restriction_present=F.max("restricted"), literal_address_guard=F.max("literal"), unrestricted_authority_write=F.max(c("replaces") * (1 - c("by_state"))),
        public_entry_point_count=F.sum("entry"), unsupported_feature=F.max("odd"),
    )
    return out.join(declared.drop("names"), "file", "left").fillna(0)


def uec(nodes: DataFrame) -> DataFrame:
    inside = nodes.filter(c("func").isNotNull() & c("stmt").isNotNull())
    low = c("callee").isin("call", "delegatecall", "staticcall")
    checked = (_type() == "FunctionCall") & c("base").isin("require", "assert") & (_has("ok") | _has("success") | _has("status"))
    top = inside.groupBy("file", "func", "stmt").agg(F.min_by(F.struct("node_type", "probe"), "id").alias("t"))
    dropped = top.filter((c("t.node_type") == "ExpressionStatement") & (F.contains("t.probe", F.lit(".call")) | F.contains("t.probe", F.lit("delegatecall")) | F.contains("t.probe", F.lit("staticcall")))).groupBy("file").agg(F.count("*").alias("result_discarded_count"))
    f = _functions(inside, low=_count(low), delegate=_count(c("callee") == "delegatecall"), checks=_count(checked), odd=_any(_type().isin(*_LOOPS)))
    out = _files(
        nodes, f, low_level_call_count=F.sum("low"), delegatecall_count=F.sum("delegate"), result_checked_count=F.sum("checks"), unhandled_call_reaches_exit=F.max(((c("low") > 0) & (c("checks") == 0)).cast("long")), unsupported_feature=F.max("odd"),
    )
    # The two features that are always 0 belong to the vector.
    return out.join(dropped, "file", "left").fillna(0).withColumns({"result_assigned_unused_count": F.lit(0).cast("long"), "revert_on_failure_present": F.lit(0).cast("long")})


def tmp(nodes: DataFrame) -> DataFrame:
    # The words are searched in the whole operation, its own operator and types included.
    timed = (_type() == "BinaryOperation") & (_has("timestamp") | _has('"name": "now"'))
    f = _functions(
        nodes, seen=_any(_member_of("block", "timestamp") | ((_type() == "Identifier") & (c("name") == "now"))), equal=_any(timed & c("op").isin("==", "!=")), modulo=_any(timed & (c("op") == "%")), interval=_any(timed & c("op").isin(">=", "<=", ">", "<")),
        calls=_any((_type() == "MemberAccess") & c("member").isin("call", "transfer", "send")), writes=_any((_type() == "Assignment") | ((_type() == "UnaryOperation") & c("op").isin("++", "--"))), odd=_any(_type().isin(*_LOOPS, "DoWhileStatement")),
    )
    return _files(
        nodes, f, has_timestamp_reference=F.max("seen"), timestamp_equality_guard=F.max("equal"), timestamp_modulo_arithmetic=F.max("modulo"), timestamp_guards_state_change=F.max(c("equal") * F.greatest("writes", "calls")),
        interval_comparison_present=F.max("interval"), external_call_present=F.max("calls"), state_write_present=F.max("writes"), unsupported_feature=F.max("odd"),
    )


_EXTRACT = {"TXO-001": txo, "REN-001": ren, "ACC-001": acc, "UEC-001": uec, "TMP-001": tmp}


def wide(nodes: DataFrame, rule: str) -> DataFrame:
    """``(file, feature...)`` for one rule; an unknown rule is an error."""
    return _EXTRACT[rule](nodes).select("file", *FEATURES[rule])


def long(nodes: DataFrame) -> DataFrame:
    """``(file, rule_id, features MAP)`` for all rules."""
    parts = [wide(nodes, r).select("file", F.lit(r).alias("rule_id"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(c(n).cast("double") for n in names))).alias("features")) for r, names in FEATURES.items()]
    return reduce(DataFrame.unionByName, parts)
