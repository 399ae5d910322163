"""Front end, path analysis, reports and patches without Spark."""

from __future__ import annotations

import json

import pytest
from spandrel.plans import ir, patch, rules
from spandrel.plans.paths import FALSE, NEVER, PERHAPS, SURELY, TRUE, Place, claim, consistent, overlap
from spandrel.sources.minisol import compile_source
from spandrel.sources.samples import SAMPLES


def _report(source: str) -> dict:
    return rules.report("a.sol", source, compile_source(source, "a.sol"))


@pytest.mark.parametrize("name", SAMPLES)
def test_sample(name):
    source, findings, undecided = SAMPLES[name]
    got = _report(source)
    count: dict[str, int] = {}
    for f in got["findings"]:
        count[f["rule_id"][:3]] = count.get(f["rule_id"][:3], 0) + 1
    assert count == findings
    assert sorted(r["rule_id"][:3] for r in got["results"] if r["reasons"]) == sorted(undecided.split())
    assert got["status"] == ("partial" if undecided else "completed")
    assert len({f["id"] for f in got["findings"]}) == len(got["findings"])
    for f in got["findings"]:
        assert 0 <= f["offset"] and f["offset"] + f["length"] <= got["byte_length"]


def test_reports_repeat():
    source = SAMPLES["several"][0]
    assert _report(source) == _report(source)


def test_delegatecall_is_severe():
    assert _report(SAMPLES["delegatecall_dropped"][0])["findings"][0]["severity"] == "high"
    assert _report(SAMPLES["call_dropped"][0])["findings"][0]["severity"] == "medium"


def test_untyped_tree_is_undecided():
    source = SAMPLES["owner_replaced"][0]
    output = json.loads(compile_source(source, "a.sol"))
    del output["sources"]["a.sol"]["ast"]["exportedSymbols"]
    got = rules.report("a.sol", source, output)
    assert not got["findings"] and all(r["status"] == "unsupported" for r in got["results"])


@pytest.mark.parametrize("output", [None, "", "{", "[]", "{}", '{"sources": {"b.sol": {}}}', '{"errors": [{"severity": "error", "message": "no"}]}'])
def test_bad_input_fails(output):
    got = rules.report("a.sol", "contract C { }", output)
    assert got["status"] == "failed" and {r["status"] for r in got["results"]} == {"failed"}


def test_positions_are_bytes():
    source = "// café\n" + SAMPLES["owner_replaced"][0]
    f = _report(source)["findings"][0]
    assert source.encode()[f["offset"] : f["offset"] + f["length"]] == b"owner"
    assert f["line"] == 4 and f["col"] == 2


def test_overlap():
    lit = lambda n: ("lit", n)
    assert overlap(Place(1, (), (lit("1"),)), Place(1, (), (lit("1"),))) == SURELY
    assert overlap(Place(1, (), (lit("1"),)), Place(1, (), (lit("2"),))) == NEVER
    assert overlap(Place(1), Place(2)) == NEVER
    assert overlap(Place(1, (), (("var", 3),)), Place(1, (), (lit("2"),))) == PERHAPS
    assert overlap(Place(1, (), (("unresolved", "", "q"),)), Place(1, (), (("unresolved", "", "q"),))) == PERHAPS
    assert overlap(Place(1, (), (("var", 3), lit("1"))), Place(1, (), (("var", 4), lit("2")))) == NEVER


def test_claims_of_a_path():
    x, y, z, one, two = ("var", 1), ("var", 2), ("var", 3), ("lit", "1"), ("lit", "12")
    binary = lambda op, a, b: ("binary", "", op, a, b)
    holds = lambda *said: consistent(tuple(claim(v, t) for v, t in said))
    assert holds((binary("==", x, y), True), (binary("==", y, z), True))
    assert not holds((binary("==", x, y), True), (binary("==", y, z), True), (binary("!=", z, x), True))
    assert not holds((binary("==", x, one), True), (binary("==", x, two), True))
    assert holds((binary("==", x, one), True), (binary("==", x, two), False))
    assert not holds((("not", x), True), (x, True)) and not holds((binary("==", x, TRUE), False), (x, True)) and holds((binary("!=", x, FALSE), True), (x, True))
    assert holds((binary("<", one, two), True)) and not holds((binary(">=", one, two), True)) and not holds((binary("<=", two, one), True))
    assert not holds((binary("<", x, y), True), (binary(">=", x, y), True)) and holds((binary("<", x, y), True), (binary("<=", x, y), True))
    assert not holds((binary("==", x, x), False)) and not holds((TRUE, False)) and holds()


def test_control_flow_answers():
    source = "contract C { uint x; function f() public { if (x == 1) { x = 2; } else { revert(); } x = 3; } }"
    program = ir.build(json.loads(compile_source(source, "a.sol")), "a.sol")
    f = program.contracts[0].functions[0]
    graph = ir.control_flow(f)
    branch = next(s for s in f.body.walk() if s.kind == "branch")
    last = [s for s in f.body.walk() if s.kind == "expression"][-1]
    assert graph.other_branch_avoids(branch.id, True, last.id) and not graph.other_branch_avoids(branch.id, False, last.id)
    assert {ir.EXIT, ir.FAIL} <= graph.reached(ir.ENTRY)


PATCHED = ["origin_guard", "origin_revert", "call_dropped", "delegatecall_dropped", "check_call_write", "hex_key", "owner_replaced", "exact_time", "exact_now", "time_remainder"]


@pytest.mark.parametrize("name", PATCHED)
def test_patch_removes_finding(name):
    source = SAMPLES[name][0]
    finding = _report(source)["findings"][0]
    new = patch.patched(source, finding)
    assert new != source
    again = _report(new)
    assert again["status"] != "failed" and finding["rule_id"] not in {f["rule_id"] for f in again["findings"]}
    assert patch.unified_diff(source, new, "a.sol").startswith("--- a/a.sol")


def test_unknown_rule_is_not_patched():
    assert patch.patched("x", {"rule_id": "ABC-001"}) == "x"


def test_patches_don_t_depend_on_lines():
    source = "// tx.origin\ncontract C { address owner; string s = \"tx.origin;\"; function f(address payable t) public { require(\n  owner ==\n  tx.origin\n ); t.transfer(1); } }"
    new = patch.patched(source, _report(source)["findings"][0])
    assert new == source.replace("==\n  tx.origin", "==\n  msg.sender") and not _report(new)["findings"]
    source = "contract C { uint x; function f(address t) public { bool success; if (x == 1) t.call(\n\"\"\n); success = true; x = 1; } }"
    finding = next(f for f in _report(source)["findings"] if f["rule_id"] == "UEC-001")
    assert '{ (bool success2, ) = t.call(\n""\n); require(success2, "call failed"); }' in patch.patched(source, finding)
    # A write in another block than the call is not moved.
    code = "contract C { function f() public { a.call(); if (x) { b = 1; } } }"
    spans = [{"description": d, "offset": code.index(w), "length": len(w)} for d, w in (("call before the write", "a.call()"), ("write of the storage", "b = 1"))]
    assert patch.patched(code, {"rule_id": "REN-001", "evidence": spans}) == code


def test_patch_without_spans():
    """A finding that has nothing but a line or a function, as a request may give it."""
    source = "contract C {\n function f() public {\n  require(tx.origin == a);\n }\n function g() public { require(tx.origin == b); }\n}\n"
    assert patch.patched(source, {"rule_id": "TXO-001", "line": 3}).count("msg.sender") == 1
    assert "msg.sender == b" in patch.patched(source, {"rule_id": "TXO-001", "function": "g"})
    assert "msg.sender == a" in patch.patched(source, {"rule_id": "TXO-001"})
    assert patch.patched(source, {"rule_id": "UEC-001", "line": 99}) == source


def test_described_programs():
    from spandrel.plans import programs

    source = SAMPLES["several"][0]
    row = programs.describe("a.sol", compile_source(source, "a.sol"))
    assert row["typed"] and row["error"] is None and {n["graph"] for n in row["nodes"]} == {f"a.sol#C.{f}" for f in "acde"}
    assert {e["kind"] for e in row["effects"]} == {"write", "read", "low_level", "transfer", "builtin"}
    ids = {(n["graph"], n["id"]) for n in row["nodes"]}
    assert all((e["graph"], x) in ids for e in row["edges"] for x in (e["src"], e["dst"])) and all((e["graph"], e["node"]) in ids for e in row["effects"])
    assert programs.describe("a.sol", "{")["error"].startswith("JSONDecodeError") and programs.describe("a.sol", None)["error"]
