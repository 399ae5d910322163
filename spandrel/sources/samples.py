"""Small contracts for trying the rules: name, source, and the findings expected per rule."""

from __future__ import annotations

_HEAD = "contract C { address owner; mapping(uint => uint) b; uint x; uint deadline; event E(uint v); "


def _c(body: str, head: str = _HEAD) -> str:
    return f"{head}\n{body}\n}}\n"


_ALL = "TXO REN ACC UEC TMP"

#: name: (source, findings by rule, rules that can't be decided)
SAMPLES: dict[str, tuple[str, dict[str, int], str]] = {
    "origin_guard": (_c("function f(address payable t) public {\n require(tx.origin == owner);\n t.transfer(1);\n}"), {"TXO": 1}, ""),
    "origin_revert": (_c("function f(address payable t) public {\n if (tx.origin != owner) revert();\n t.transfer(1);\n}"), {"TXO": 1}, ""),
    "origin_two_guards": (_c("function f(address payable t) public {\n require(tx.origin == owner);\n require(owner == tx.origin);\n t.transfer(1);\n}"), {"TXO": 2}, ""),
    "origin_two_effects": (_c("function f(address payable t) public {\n require(tx.origin == owner);\n t.transfer(1);\n x = 2;\n}"), {"TXO": 1}, ""),
    "origin_reconnects": (_c("function f() public {\n if (tx.origin == owner) { }\n x = 2;\n}"), {}, ""),
    "origin_emitted": (_c("event O(address a); function f() public {\n emit O(tx.origin);\n}"), {}, ""),
    "origin_copied": (_c("function f() public {\n address o = tx.origin;\n require(o == owner);\n x = 1;\n}"), {}, "TXO"),
    "caller_guard": (_c("function f(address payable t) public {\n assert(msg.sender == owner);\n t.transfer(1);\n}"), {}, ""),
    "check_call_write": (_c("function f(address t) public {\n require(b[1] > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[1] = 0;\n}"), {"REN": 1}, ""),
    "check_by_local": (_c("function f(address t) public {\n uint v = b[1];\n require(v > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[1] = 0;\n}"), {"REN": 1}, ""),
    "hex_key": (_c("function f(address t) public {\n require(b[1] > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[0x01] = 0;\n}"), {"REN": 1}, ""),
    "write_first": (_c("function f(address t) public {\n require(b[1] > 0);\n b[1] = 0;\n (bool ok, ) = t.call(\"\");\n require(ok);\n}"), {}, ""),
    "other_key": (_c("function f(address t) public {\n require(b[1] > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[2] = 0;\n}"), {}, ""),
    "unit_key": (_c("function f(address t) public {\n require(b[1 ether] > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[1] = 0;\n}"), {}, ""),
    "symbolic_keys": (_c("function f(address t, uint i, uint j) public {\n require(b[i] > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[j] = 0;\n}"), {}, "REN"),
    "stale_local": (_c("function f(address t) public {\n uint v = b[1];\n b[1] = 0;\n require(v > 0);\n t.staticcall(\"\");\n}"), {"UEC": 1}, "REN"),
    "view_call": ("interface I { function g() external view returns (uint); }\n" + _c("function f(I t) public {\n require(b[1] > 0);\n t.g();\n b[1] = 0;\n}"), {}, ""),
    "owner_replaced": (_c("function f(address n) public {\n owner = n;\n}"), {"ACC": 1}, ""),
    "owner_replaced_under_flag": (_c("function f(address n, bool go) public {\n if (go) owner = n;\n}"), {"ACC": 1}, ""),
    "owner_guarded": (_c("function f(address n) public {\n require(msg.sender == owner);\n owner = n;\n}"), {}, ""),
    "owner_by_modifier": (_c("modifier only() { require(msg.sender == owner); _; }\nfunction f(address n) public only {\n owner = n;\n}"), {}, ""),
    "owner_by_literal": (_c("function f(address n) public {\n require(msg.sender == address(0x12));\n owner = n;\n}"), {}, ""),
    "owner_by_state": (_c("function f(address n) public {\n require(x == 7);\n owner = n;\n}"), {}, "ACC"),
    "new_owner_untrusted": (_c("function f(address n) public {\n owner = n;\n require(msg.sender == owner);\n owner = n;\n}"), {"ACC": 2}, ""),
    "authority_by_use": ("contract C { address boss; uint x;\nfunction g() public {\n require(msg.sender == boss);\n x = 1;\n}\nfunction f(address n) public {\n boss = n;\n}\n}\n", {"ACC": 1}, ""),
    "call_dropped": (_c("function f(address t) public {\n t.call(\"\");\n}"), {"UEC": 1}, ""),
    "call_required": (_c("function f(address t) public {\n (bool ok, ) = t.call(\"\");\n require(ok);\n}"), {}, ""),
    "call_failure_handled": (_c("function f(address t) public {\n (bool ok, ) = t.call(\"\");\n if (!ok) { x = 1; }\n}"), {}, ""),
    "call_failure_empty": (_c("function f(address t) public {\n (bool ok, ) = t.call(\"\");\n if (!ok) { }\n}"), {"UEC": 1}, ""),
    "call_overwritten": (_c("function f(address t) public {\n bool ok;\n (ok, ) = t.call(\"\");\n ok = true;\n require(ok);\n}"), {"UEC": 1}, ""),
    "delegatecall_dropped": (_c("function f(address t) public {\n t.delegatecall(\"\");\n}"), {"UEC": 1}, ""),
    "result_returned": (_c("function f(address t) public returns (bool) {\n (bool ok, ) = t.call(\"\");\n return ok;\n}"), {}, "UEC"),
    "result_combined": (_c("function f(address t) public {\n (bool ok, ) = t.call(\"\");\n bool z = ok == true;\n require(z);\n}"), {}, "UEC"),
    "impossible_path": (_c("function f(address t) public {\n (bool ok, ) = t.call(\"\");\n if (x == 1) { if (x == 2) { owner = t; } }\n require(ok);\n}"), {}, ""),
    "constant_guard": (_c("function f(address n) public {\n require(false);\n owner = n;\n}"), {}, ""),
    "terminated": (_c("function f(address n) public {\n owner = n;\n revert();\n}"), {}, ""),
    "exact_time": (_c("function f() public {\n require(block.timestamp == deadline);\n x = 1;\n}"), {"TMP": 1}, ""),
    "exact_now": (_c("function f() public {\n if (now != deadline) revert();\n x = 1;\n}"), {"TMP": 1}, ""),
    "time_bound": (_c("function f() public {\n require(block.timestamp >= deadline);\n x = 1;\n}"), {}, ""),
    "time_remainder": (_c("function f() public {\n uint r = block.timestamp % 10;\n x = r;\n}"), {"TMP": 1}, ""),
    "composite": (_c("function f() public {\n require(x == 1 && deadline == 2);\n x = 1;\n}"), {}, _ALL),
    "loop": (_c("function f() public {\n while (x == 1) { x = 2; }\n}"), {}, _ALL),
    "increment": (_c("function f() public {\n x++;\n}"), {}, _ALL),
    "internal_call": (_c("function g() internal { }\nfunction f() public {\n g();\n}"), {}, _ALL),
    "inherited": ("contract A { }\ncontract C is A { function f() public { } }\n", {}, _ALL),
    "storage_pointer": ("contract C { uint[] a; function f() public {\n uint[] storage p = a;\n}\n}\n", {}, _ALL),
    "odd_modifier": (_c("modifier m() { if (x == 1) { _; } }\nfunction f() public m {\n x = 2;\n}"), {}, _ALL),
    "several": (_c("function a(address n) public {\n owner = n;\n}\nfunction c(address t) public {\n t.call(\"\");\n}\nfunction d(address payable t) public {\n require(tx.origin == owner);\n t.transfer(1);\n}\nfunction e(address t) public {\n require(b[1] > 0);\n (bool ok, ) = t.call(\"\");\n require(ok);\n b[1] = 0;\n}"), {"TXO": 1, "REN": 1, "ACC": 1, "UEC": 1}, ""),
}
