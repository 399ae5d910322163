"""Syntax trees as a table.

Every object of a tree becomes a row with its number in reading order and the number
of the last row below it, so that a subtree is a range and containment a comparison.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

_TEXT = ("node_type", "name", "member", "op", "kind", "visibility")
_SCHEMA = pa.schema([
    ("file", pa.string()), ("id", pa.int64()), ("last", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("key", pa.string()),
    *((c, pa.string()) for c in _TEXT), ("state", pa.bool_()), ("base", pa.string()), ("callee", pa.string()), ("func", pa.int64()), ("stmt", pa.int32()), ("assigned", pa.bool_()), ("probe", pa.string()),
])
SCHEMA = "file string, id bigint, last bigint, parent bigint, depth int, key string, node_type string, name string, member string, op string, kind string, visibility string, state boolean, base string, callee string, func bigint, stmt int, assigned boolean, probe string"


def _callee(node: dict) -> str | None:
    """Name of the member that a call calls, through call options."""
    e = node.get("expression") or {}
    if e.get("nodeType") == "FunctionCallOptions":
        e = e.get("expression") or {}
    return e.get("memberName") if e.get("nodeType") == "MemberAccess" else None


def _probe(node: dict, kind: str | None) -> str | None:
    """Serialized operands, for features that search text."""
    if kind == "BinaryOperation":
        return json.dumps(node.get("leftExpression", {})) + " " + json.dumps(node.get("rightExpression", {}))
    if kind == "ExpressionStatement":
        return json.dumps(node)
    if kind == "FunctionCall" and (node.get("expression") or {}).get("nodeType") == "Identifier" and (node.get("arguments") or []):
        return json.dumps(node["arguments"][0])
    return None


def first_contract(tree: dict) -> dict:
    """The first contract definition in reading order, else the tree itself."""
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if x.get("nodeType") == "ContractDefinition":
                return x
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return tree


def rows_of(file: str, tree: dict) -> list[dict]:
    """The rows of one tree; ``func`` and ``stmt`` are set within functions of the first contract."""
    out: list[dict] = []
    home = first_contract(tree)
    tops = {id(n): n for n in home.get("nodes", []) if isinstance(n, dict) and n.get("nodeType") == "FunctionDefinition"}
    steps = {id(s): i for f in tops.values() for i, s in enumerate((f.get("body") or {}).get("statements", []))}
    # (object, parent row, depth, key, function row, statement, within an assignment's target); a number closes a row
    todo: list = [(tree, None, 0, None, None, None, False)]
    while todo:
        item = todo.pop()
        if isinstance(item, int):
            out[item]["last"] = len(out) - 1
            continue
        node, parent, depth, key, func, stmt, assigned = item
        if isinstance(node, list):
            todo.extend((x, parent, depth, key, func, stmt, assigned) for x in reversed(node))
            continue
        if not isinstance(node, dict):
            continue
        number, kind = len(out), node.get("nodeType")
        if id(node) in tops:
            func = number
        stmt = steps.get(id(node), stmt)
        e = node.get("expression")
        text = {"node_type": kind, "name": node.get("name"), "member": node.get("memberName"), "op": node.get("operator"), "kind": node.get("kind"), "visibility": node.get("visibility")}
        out.append({
            "file": file, "id": number, "last": number, "parent": parent, "depth": depth, "key": key, **{k: v if isinstance(v, str) else None for k, v in text.items()},
            "state": bool(node.get("stateVariable")) and any(node is n for n in home.get("nodes", [])), "base": e.get("name") if isinstance(e, dict) else None, "callee": _callee(node) if kind == "FunctionCall" else None,
            "func": func, "stmt": stmt, "assigned": assigned, "probe": _probe(node, kind),
        })
        todo.append(number)
        for k, v in reversed(list(node.items())):
            if isinstance(v, dict | list):
                todo.append((v, number, depth + 1, k, func, stmt, assigned or (kind == "Assignment" and k == "leftHandSide")))
    return out


def flatten(files: DataFrame) -> DataFrame:
    """The rows of the trees of all ``(file, output)``; output without a tree for its file gives none."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    tree = json.loads(r["output"] or "")["sources"][r["file"]]["ast"]
                except (ValueError, KeyError, TypeError):
                    continue
                rows.extend(rows_of(r["file"], tree))
            yield from pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches()

    return files.select("file", "output").mapInArrow(run, SCHEMA)
