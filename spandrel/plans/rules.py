"""The analysis of many files as one DataFrame transformation.

``analyze`` maps compiler output to reports where the rows are; what follows (findings,
results, summaries) is relational over it.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import RULES, SEVERITIES, zero_filled
from . import ir
from .paths import Analysis

SPAN = [("offset", pa.int64()), ("length", pa.int64()), ("line", pa.int64()), ("col", pa.int64()), ("end_line", pa.int64()), ("end_col", pa.int64())]
_EVIDENCE = pa.struct([("description", pa.string()), *SPAN])
_FINDING = pa.struct([*((c, pa.string()) for c in ("id", "rule_id", "severity", "confidence", "contract", "function", "explanation")), *SPAN, ("evidence", pa.list_(_EVIDENCE))])
_RESULT = pa.struct([("rule_id", pa.string()), ("status", pa.string()), ("reasons", pa.list_(pa.string()))])
_REPORT = pa.schema([("file", pa.string()), ("status", pa.string()), ("byte_length", pa.int64()), ("error", pa.string()), ("findings", pa.list_(_FINDING)), ("results", pa.list_(_RESULT))])
_SPAN_SQL = "offset: bigint, length: bigint, line: bigint, col: bigint, end_line: bigint, end_col: bigint"
SCHEMA = f"file string, status string, byte_length bigint, error string, findings array<struct<id: string, rule_id: string, severity: string, confidence: string, contract: string, function: string, explanation: string, {_SPAN_SQL}, evidence: array<struct<description: string, {_SPAN_SQL}>>>>, results array<struct<rule_id: string, status: string, reasons: array<string>>>"


def spans_of(source: str):
    """Positions as offset and length, line and byte column of both ends, for byte ranges of ``source``."""
    data = source.encode("utf-8", "surrogatepass")
    starts = [0, *(i + 1 for i, b in enumerate(data) if b == 10)]

    def at(offset: int) -> tuple[int, int]:
        line = bisect_right(starts, offset)
        return line, offset - starts[line - 1] + 1

    def span(place: tuple[int, int] | None) -> dict:
        if place is None or sum(place) > len(data):
            return dict.fromkeys(name for name, _ in SPAN)
        (a, b), (c, d) = at(place[0]), at(sum(place))
        return {"offset": place[0], "length": place[1], "line": a, "col": b, "end_line": c, "end_col": d}

    return span


def report(file: str, source: str | None, output: str | dict | None) -> dict:
    """One file's report; what can't be analysed gives a failed one, with every rule failed."""
    row = {"file": file, "byte_length": len((source or "").encode("utf-8", "surrogatepass")), "error": None, "findings": []}
    try:
        parsed = json.loads(output) if isinstance(output, str) else output
        if not isinstance(parsed, dict) or source is None or file is None:
            raise ir.InvalidInput("file, source and compiler output are required")
        analysis = Analysis(ir.build(parsed, file), spans_of(source))
        analysis.run()
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError) as e:
        return row | {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500], "results": [{"rule_id": r, "status": "failed", "reasons": []} for r in RULES]}
    results = [{"rule_id": r, "status": "unsupported" if why else "completed", "reasons": sorted(why)} for r, why in analysis.reasons.items()]
    return row | {"status": "partial" if any(r["reasons"] for r in results) else "completed", "findings": [analysis.findings[k] for k in sorted(analysis.findings)], "results": results}


def analyze(files: DataFrame) -> DataFrame:
    """A report for every row ``(file, source, output)``."""

    def run(batches):
        for batch in batches:
            rows = [report(r["file"], r["source"], r["output"]) for r in batch.to_pylist()]
            yield from pa.Table.from_pylist(rows, schema=_REPORT).to_batches()

    return files.select("file", "source", "output").mapInArrow(run, SCHEMA)


def findings(reports: DataFrame) -> DataFrame:
    return reports.select("file", F.explode("findings").alias("f")).select("file", "f.*")


def results(reports: DataFrame) -> DataFrame:
    return reports.select("file", F.explode("results").alias("r")).select("file", "r.*")


def summary(reports: DataFrame) -> DataFrame:
    """``(file, rule_id, severity, n)`` with zeros for all rules and severities of every file."""
    rules = reports.select("file", F.explode(F.array(*map(F.lit, RULES))).alias("rule_id"))
    domain = rules.select("file", "rule_id", F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"))
    return zero_filled(domain, findings(reports).groupBy("file", "rule_id", "severity").agg(F.count("*").alias("n")), ["file", "rule_id", "severity"])
