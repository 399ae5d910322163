"""Programs and their control-flow graphs as tables, for the graph operators.

A graph is a function with a body, named ``file#contract.function`` (and its place among
those of the same name).  Its nodes are statements and three of its own: the entry and
the normal and exceptional exits.  A node is ``uncertain`` if what it does, or what
follows it, is outside the representation, and ``unordered`` if more than one call or
access to state stands in it, so that their order is not known.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ir

NODE = pa.struct([("graph", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("entry", pa.bool_()), ("exit", pa.bool_()), ("uncertain", pa.bool_()), ("unordered", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64())])
EDGE = pa.struct([("graph", pa.string()), ("src", pa.int64()), ("dst", pa.int64()), ("kind", pa.string())])
EFFECT = pa.struct([("graph", pa.string()), ("id", pa.int64()), ("node", pa.int64()), ("kind", pa.string()), ("name", pa.string())])
_TABLES = pa.schema([("file", pa.string()), ("error", pa.string()), ("typed", pa.bool_()), ("nodes", pa.list_(NODE)), ("edges", pa.list_(EDGE)), ("effects", pa.list_(EFFECT))])
SCHEMA = (
    "file string, error string, typed boolean, "
    "nodes array<struct<graph:string,id:bigint,kind:string,entry:boolean,exit:boolean,uncertain:boolean,unordered:boolean,offset:bigint,length:bigint>>, "
    "edges array<struct<graph:string,src:bigint,dst:bigint,kind:string>>, effects array<struct<graph:string,id:bigint,node:bigint,kind:string,name:string>>"
)
_OWN = {ir.ENTRY: "entry", ir.EXIT: "exit", ir.FAIL: "failure"}


def describe(file: str, output: str | dict | None) -> dict:
    """One file's row: its program as tables, or why there is none."""
    row = {"file": file, "error": None, "typed": None, "nodes": [], "edges": [], "effects": []}
    try:
        program = ir.build(json.loads(output) if isinstance(output, str) else output or {}, file)
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"[:500]}
    row["typed"] = program.typed
    names: Counter[str] = Counter()
    for contract in program.contracts:
        for f in contract.functions:
            if f.body is None:
                continue
            name = f"{file}#{contract.name}.{f.name}"
            names[name] += 1
            graph = name if names[name] == 1 else f"{name}#{names[name]}"
            flow = ir.control_flow(f)
            for number, kind in _OWN.items():
                row["nodes"].append({"graph": graph, "id": number, "kind": kind, "entry": number == ir.ENTRY, "exit": number != ir.ENTRY, "uncertain": False, "unordered": False, "offset": None, "length": None})
            for s in flow.statements.values():
                at = s.at or (None, None)
                row["nodes"].append({"graph": graph, "id": s.id, "kind": s.kind, "entry": False, "exit": False, "uncertain": s.kind == "unsupported", "unordered": len(s.calls) + len(s.accesses) > 1, "offset": at[0], "length": at[1]})
                row["effects"] += [{"graph": graph, "id": c.expr.id, "node": s.id, "kind": c.kind, "name": c.name} for c in s.calls]
                row["effects"] += [{"graph": graph, "id": a.id, "node": s.id, "kind": "write" if a.write else "read", "name": contract.state[a.variable].name} for a in s.accesses]
            row["edges"] += [{"graph": graph, "src": src, "dst": to, "kind": kind} for src, out in flow.edges.items() for to, kind in out]
    return row


def programs(files: DataFrame) -> DataFrame:
    """A row of tables for every row ``(file, output)``."""

    def run(batches):
        for batch in batches:
            yield from pa.Table.from_pylist([describe(r["file"], r["output"]) for r in batch.to_pylist()], schema=_TABLES).to_batches()

    return files.select("file", "output").mapInArrow(run, SCHEMA)


def nodes(tables: DataFrame) -> DataFrame:
    return tables.select("file", F.inline("nodes"))


def edges(tables: DataFrame) -> DataFrame:
    return tables.select("file", F.inline("edges"))


def effects(tables: DataFrame) -> DataFrame:
    """``(file, graph, id, node, kind, name)``: calls and accesses to state, by which nodes can be looked up."""
    return tables.select("file", F.inline("effects"))
