"""Source patches for findings, and their verification by analysing again.

A patch edits the source at the byte ranges of the finding and its evidence, which come
from the syntax tree, so that it does not matter how a statement is laid out on lines;
everything around it is relational.  The compiler is injected, as nothing here compiles.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.inputs import compile_sources
from . import rules

MOST_PASSES = 6
#: Fixed replacement texts.
UNAUTHORIZED, FAILED = b'"unauthorized"', b'"call failed"'
ENTROPY = b"uint256(keccak256(abi.encodePacked(blockhash(block.number - 1), msg.sender)))"

_ORIGIN = re.compile(rb"\btx\.origin\b")
_NOT_CODE = re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
_BOUND = re.compile(rb"(?:\(\s*)?(?:bool\s+)?(\w+)\s*(?:,[^=]*)?\)?\s*=\s*$")
_EXACT = re.compile(rb"==|!=")
_DECLARED = re.compile(rb"(\w+)\s*(?:=[^;]*)?;?\s*$")


class Code:
    """A source in bytes, and the same with strings and comments blanked, in which places are looked for."""

    def __init__(self, source: str):
        self.data = source.encode("utf-8", "surrogatepass")
        self.plain = _NOT_CODE.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), self.data)

    def span(self, finding: dict, *names: str) -> tuple[int, int] | None:
        """The range of the first evidence so described, else, without names, of the finding itself or of its line."""
        for name in names:
            for e in finding.get("evidence") or ():
                if e["description"] == name and e.get("offset") is not None:
                    return e["offset"], e["offset"] + e["length"]
        if names:
            return None
        if finding.get("offset") is not None:
            return finding["offset"], finding["offset"] + finding["length"]
        lines = [0, *(m.end() for m in re.finditer(rb"\n", self.data)), len(self.data)]
        n = finding.get("line") or 0
        if not 0 < n < len(lines) or not (line := self.data[lines[n - 1] : lines[n]]).strip():
            return None
        return lines[n - 1] + len(line) - len(line.lstrip()), lines[n - 1] + len(line.rstrip())

    def statement(self, span: tuple[int, int]) -> tuple[int, int]:
        """The statement around a range: from after the last ``;``, ``{`` or ``}`` before it to the next ``;``."""
        start = 1 + max(self.plain.rfind(c, 0, span[0]) for c in (b";", b"{", b"}"))
        start += len(self.plain[start : span[0]]) - len(self.plain[start : span[0]].lstrip())
        end = self.plain.find(b";", span[1] if self.plain[span[0] : span[1]][-1:] != b";" else span[1] - 1)
        return start, (len(self.data) if end < 0 else end + 1)

    def function(self, finding: dict) -> tuple[int, int] | None:
        """The body of the finding's function, inside its braces."""
        at = self.span(finding, "entry point", "normal end")
        if at is None:
            m = re.search(rb"\bfunction\s+" + re.escape((finding.get("function") or "").encode()) + rb"\b", self.plain)
            if not finding.get("function") or m is None:
                return None
            at = m.span()
        start = self.plain.find(b"{", at[0]) + 1
        if not start:
            return None
        depth = 1
        for m in re.finditer(rb"[{}]", self.plain[start:]):
            depth += 1 if m[0] == b"{" else -1
            if not depth:
                return start, start + m.start()
        return start, len(self.data)

    def indent(self, at: int) -> bytes:
        line = self.data[self.data.rfind(b"\n", 0, at) + 1 :]
        return line[: len(line) - len(line.lstrip(b" \t"))]

    def edited(self, *edits: tuple[int, int, bytes]) -> str:
        """The source with ranges replaced; ranges don't overlap."""
        out, at = [], 0
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            out += [self.data[at:start], new]
            at = end
        return b"".join([*out, self.data[at:]]).decode("utf-8", "surrogatepass")


def use_caller(code: Code, finding: dict) -> str | None:
    """tx.origin becomes msg.sender in the finding's statement; where none is there, in its function; else the first one of all."""
    own, body = code.span(finding), code.function(finding)
    for start, end, most in ((*code.statement(own), None) if own else (0, 0, None), (*body, None) if body else (0, 0, None), (0, len(code.data), 1)):
        found = [m.span() for m in _ORIGIN.finditer(code.plain, start, end)][:most]
        if found:
            return code.edited(*((a, z, b"msg.sender") for a, z in found))
    return None


def check_result(code: Code, finding: dict) -> str | None:
    """The call's result is required right after its statement; a call whose result is dropped is bound first."""
    call = code.span(finding, "low-level call") or code.span(finding)
    if call is None:
        return None
    start, end = code.statement(call)
    before = code.plain[start : call[0]]
    pad = b"\n" + code.indent(start)
    bound = _BOUND.search(before)
    if bound:
        check = b"require(" + bound[1] + b", " + FAILED + b");"
        return None if code.plain[end:].lstrip().startswith(b"require(" + bound[1]) else code.edited((end, end, pad + check))
    name = next(n for n in (b"success", *(b"success%d" % i for i in range(2, 1000))) if not re.search(rb"\b" + n + rb"\b", code.plain))
    bind, check = b"(bool " + name + b", ) = ", b"require(" + name + b", " + FAILED + b");"
    if not before.strip():
        return code.edited((call[0], call[0], bind), (end, end, pad + check))
    # The only statement of a branch or loop becomes a block of two.
    return code.edited((call[0], call[0], b"{ " + bind), (end, end, b" " + check + b" }")) if before.rstrip().endswith((b")", b"else")) else None


def write_first(code: Code, finding: dict) -> str | None:
    """The statement of the write moves to before that of the call, if both stand in the same block."""
    call, write = code.span(finding, "call before the write"), code.span(finding, "write of the storage")
    if not (call and write):
        return None
    (start, end), (a, z) = code.statement(call), code.statement(write)
    between = code.plain[end:a]
    if a < end or between.count(b"{") != between.count(b"}"):
        return None
    left = len(code.data[:a].rstrip(b" \t\n"))
    return code.edited((start, start, code.data[a:z] + b"\n" + code.indent(start)), (left, z, b""))


def guard_entry(code: Code, finding: dict) -> str | None:
    """The function begins with a check of its caller against the authority that the finding names."""
    body = code.function(finding)
    declared, used = code.span(finding, "authority"), code.span(finding, "replacement") or code.span(finding)
    name = _DECLARED.search(code.plain[slice(*declared)]) if declared else None
    owner = name[1] if name else code.plain[slice(*used)].strip() if used else b""
    if body is None or not re.fullmatch(rb"\w+", owner):
        return None
    first = re.match(rb"\s*\n([ \t]*)\S", code.data[body[0] :])
    pad = first[1] if first else code.indent(body[0]) + b"    "
    return code.edited((body[0], body[0], b"\n" + pad + b"require(msg.sender == " + owner + b", " + UNAUTHORIZED + b");"))


def loosen_time(code: Code, finding: dict) -> str | None:
    """An exact time becomes a bound; a remainder of the time becomes one of a block hash."""
    rest = code.span(finding, "remainder")
    if rest:
        at = code.plain.find(b"%", *rest)
        return code.edited((rest[0], len(code.data[:at].rstrip()), ENTROPY)) if at >= 0 else None
    guard = code.span(finding, "guard") or code.span(finding)
    exact = _EXACT.search(code.plain, *(guard if code.span(finding, "guard") else code.statement(guard))) if guard else None
    return code.edited((*exact.span(), b">=" if exact[0] == b"==" else b"<")) if exact else None


PATCHES = {"TXO-001": use_caller, "UEC-001": check_result, "REN-001": write_first, "ACC-001": guard_entry, "TMP-001": loosen_time}


def patched(source: str, finding: dict) -> str:
    """The source with a finding's patch; unchanged if there is none for its rule, or none that fits."""
    change = PATCHES.get(finding.get("rule_id"))
    return (change(Code(source), finding) if change else None) or source


def unified_diff(old: str, new: str, file: str) -> str:
    return "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{file}", f"b/{file}", lineterm=""))


def propose(candidates: DataFrame) -> DataFrame:
    """``(file, id, rank, rule_id, function, before, source, diff)``: patches of ``candidates(file, source, rank, finding STRUCT)`` that change something."""
    schema = pa.schema([("file", pa.string()), ("id", pa.string()), ("rank", pa.int32()), ("rule_id", pa.string()), ("function", pa.string()), ("before", pa.int32()), ("source", pa.string()), ("diff", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                new = patched(r["source"], r["finding"])
                if new != r["source"]:
                    f = r["finding"]
                    rows.append({"file": r["file"], "id": f["id"], "rank": r["rank"], "rule_id": f["rule_id"], "function": f["function"], "before": r["before"], "source": new, "diff": unified_diff(r["source"], new, r["file"])})
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return candidates.select("file", "source", "rank", "before", "finding").mapInArrow(run, "file string, id string, rank int, rule_id string, function string, before int, source string, diff string")


_CHECKED = pa.schema([("status", pa.string()), ("remaining", pa.int32()), ("regressed", pa.bool_())])


def verify(proposals: DataFrame, provider) -> DataFrame:
    """``proposals`` with ``status``, the ``remaining`` findings, and ``regressed``: whether there are more than before.

    A patch is verified when it compiles and neither its finding nor its rule in the same function is found again.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                output = provider(r["source"], r["file"])
                again = rules.report(r["file"], r["source"], output)
                if again["status"] == "failed":
                    rows.append({"status": "compilation_failed" if "compiler errors" in (again["error"] or "") else "analyzer_failed", "remaining": None, "regressed": None})
                    continue
                left = any(f["id"] == r["id"] or (f["rule_id"], f["function"]) == (r["rule_id"], r["function"]) for f in again["findings"])
                n = len(again["findings"])
                rows.append({"status": "unverified" if left else "verified", "remaining": n, "regressed": n > r["before"]})
            extra = pa.Table.from_pylist(rows, schema=_CHECKED).combine_chunks()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in extra.columns)], [*batch.schema.names, *_CHECKED.names])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in proposals.schema)
    return proposals.mapInArrow(run, f"{types}, status string, remaining int, regressed boolean")


def candidates(files: DataFrame, reports: DataFrame) -> DataFrame:
    """``(file, source, rank, before, finding)`` for every finding of ``files(file, source)``, in the order of their ids."""
    each = reports.select("file", F.size("findings").alias("before"), F.posexplode("findings").alias("rank", "finding"))
    return files.select("file", "source").join(each, "file")


def remediate(files: DataFrame, provider, cut, passes: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """Sources after up to ``passes`` verified fixes each, and the fixes.  A pass is one batch over all files that have one left.

    ``files(file, source)``; ``provider(source, file)`` compiles; ``cut`` writes a pass's result and ends its lineage.
    """
    now = cut(files.select("file", "source"))
    done = None
    for i in range(passes):
        reports = rules.analyze(compile_sources(now, provider))
        fixes = verify(propose(candidates(now, reports)), provider).filter("status = 'verified' AND NOT regressed")
        first = fixes.groupBy("file").agg(F.min_by(F.struct(*[c for c in fixes.columns if c != "file"]), "rank").alias("x")).select("file", "x.*", F.lit(i + 1).alias("pass"))
        first = cut(first)
        if first.isEmpty():
            break
        done = first if done is None else done.unionByName(first)
        new = first.select("file", F.col("source").alias("_new"))
        now = cut(now.join(new, "file", "left").select("file", F.coalesce("_new", "source").alias("source")))
    if done is None:
        done = first
    return now, done.drop("source")
