"""A compiler front end for a small subset of Solidity, giving typed syntax trees.

It serves tests, samples and verification of patches where no real compiler is at
hand.  What it doesn't know is an error in its output, as a compiler's would be.
"""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<hex>0x[0-9a-fA-F]+)|(?P<num>\d[\d_]*)|(?P<str>\"[^\"\n]*\")|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>=>|\+\+|--|&&|\|\||[=!<>]=|[-+*/%]=|[-+*/%=<>!(){}\[\].,;:?])", re.S)
_UNITS = {"wei": 1, "gwei": 10**9, "ether": 10**18, "seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
_ELEMENTARY = re.compile(r"(?:u?int\d*|address|bool|bytes\d*|string)$")
_LEVELS = [("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]
_BARE = {"call": "barecall_payable", "delegatecall": "baredelegatecall_nonpayable", "staticcall": "barestaticcall_view", "transfer": "transfer_nonpayable", "send": "send_nonpayable"}


class Unsupported(ValueError):
    pass


class _Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, int, int]] = []
        at = byte = 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise Unsupported(f"unexpected {source[at]!r}")
            size = len(m[0].encode())
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], byte, byte + size))
            at, byte = m.end(), byte + size
        self.tokens.append(("end", "", byte, byte))
        self.i, self.ids = 0, 0
        self.scopes: list[dict[str, tuple[int, str]]] = [{}]
        self.contracts: dict[str, dict[str, str]] = {}
        self.contract = ""

    # -- tokens

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)][1]

    def take(self, want: str | None = None) -> str:
        kind, text, _, _ = self.tokens[self.i]
        if kind == "end" or (want is not None and text != want):
            raise Unsupported(f"expected {want or 'more'}, found {text or 'the end'!r}")
        self.i += 1
        return text

    def accept(self, *texts: str) -> str | None:
        return self.take() if self.peek() in texts and self.tokens[self.i][0] != "str" else None

    def node(self, node_type: str, start: int, /, **fields) -> dict:
        self.ids += 1
        return {"id": self.ids, "nodeType": node_type, "src": f"{start}:{self.tokens[self.i - 1][3] - start}:0", **fields}

    @property
    def at(self) -> int:
        return self.tokens[self.i][2]

    # -- declarations

    def unit(self) -> dict:
        start, nodes = self.at, []
        while self.tokens[self.i][0] != "end":
            if self.accept("pragma"):
                while self.take() != ";":
                    pass
            else:
                nodes.append(self.definition())
        return self.node("SourceUnit", start, nodes=nodes, exportedSymbols={n["name"]: [n["id"]] for n in nodes})

    def definition(self) -> dict:
        start = self.at
        kind = self.accept("contract", "interface", "library")
        if not kind:
            raise Unsupported(f"unexpected {self.peek()!r}")
        name, bases = self.take(), []
        self.contract = name
        self.contracts[name] = {}
        if self.accept("is"):
            bases = [self.take()]
            while self.accept(","):
                bases.append(self.take())
        self.take("{")
        self._declare_functions()
        self.scopes.append({})
        nodes = []
        while not self.accept("}"):
            nodes.append(self.member())
        self.scopes.pop()
        return self.node("ContractDefinition", start, name=name, contractKind=kind, baseContracts=[{"nodeType": "InheritanceSpecifier", "baseName": {"name": b}} for b in bases], nodes=nodes)

    def _declare_functions(self) -> None:
        """Names and mutability of the functions of the contract that begins here."""
        depth, i = 1, self.i
        while depth and i < len(self.tokens):
            t = self.tokens[i][1]
            depth += {"{": 1, "}": -1}.get(t, 0)
            if depth == 1 and t == "function":
                j = i
                while self.tokens[j][1] not in ("{", ";", ""):
                    j += 1
                head = {x[1] for x in self.tokens[i:j]}
                self.contracts[self.contract][self.tokens[i + 1][1]] = next((m for m in ("view", "pure", "payable") if m in head), "nonpayable")
            i += 1

    def member(self) -> dict:
        start = self.at
        if self.peek() in ("function", "constructor", "receive", "fallback"):
            return self.function()
        if self.accept("modifier"):
            name, parameters = self.take(), []
            self.scopes.append({})
            if self.accept("("):
                parameters = self.parameters(")")
            body = self.block()
            self.scopes.pop()
            return self.node("ModifierDefinition", start, name=name, parameters={"parameters": parameters}, body=body)
        if self.accept("event", "error"):
            name = self.take()
            self.take("(")
            self.scopes.append({})
            parameters = self.parameters(")")
            self.scopes.pop()
            self.take(";")
            self.scopes[-1][name] = (0, "event")
            return self.node("EventDefinition", start, name=name, parameters={"parameters": parameters})
        kind = self.type_name()
        while self.accept("public", "private", "internal", "immutable", "constant"):
            pass
        name, value = self.take(), None
        if self.accept("="):
            value = self.expression()
        self.take(";")
        return self._variable(start, name, kind, stateVariable=True, value=value)

    def _variable(self, start: int, name: str, kind: str, **fields) -> dict:
        node = self.node("VariableDeclaration", start, name=name, typeDescriptions={"typeString": kind}, typeName={"name": kind}, **{"storageLocation": "default", **fields})
        if name:
            self.scopes[-1][name] = (node["id"], kind)
        return node

    def type_name(self) -> str:
        if self.accept("mapping"):
            self.take("(")
            key = self.type_name()
            self.take("=>")
            value = self.type_name()
            self.take(")")
            return f"mapping({key} => {value})"
        name = self.take()
        if not (_ELEMENTARY.match(name) or name in self.contracts):
            raise Unsupported(f"unknown type {name}")
        if name == "address" and self.accept("payable"):
            name = "address payable"
        while self.accept("["):
            self.take("]")
            name += "[]"
        return name

    def parameters(self, end: str) -> list[dict]:
        out = []
        while not self.accept(end):
            start, kind = self.at, self.type_name()
            self.accept("indexed")
            where = self.accept("memory", "calldata", "storage") or "default"
            name = self.take() if self.tokens[self.i][0] == "id" else ""
            out.append(self._variable(start, name, kind, storageLocation=where))
            self.accept(",")
        return out

    def function(self) -> dict:
        start, kind = self.at, self.take()
        name = self.take() if kind == "function" else ""
        self.scopes.append({})
        self.take("(")
        parameters, returns, visibility, mutability, modifiers = self.parameters(")"), [], "public", "nonpayable", []
        while self.peek() not in ("{", ";"):
            word = self.accept("public", "external", "internal", "private", "view", "pure", "payable", "returns", "virtual", "override")
            if word in ("public", "external", "internal", "private"):
                visibility = word
            elif word in ("view", "pure", "payable"):
                mutability = word
            elif word == "returns":
                self.take("(")
                returns = self.parameters(")")
            elif not word:
                begin, used, arguments = self.at, self.take(), []
                if self.accept("("):
                    arguments = self.arguments(")")
                modifiers.append(self.node("ModifierInvocation", begin, modifierName={"name": used}, arguments=arguments))
        body = None if self.accept(";") else self.block()
        self.scopes.pop()
        return self.node("FunctionDefinition", start, name=name, kind=kind, visibility=visibility, stateMutability=mutability, parameters={"parameters": parameters}, returnParameters={"parameters": returns}, modifiers=modifiers, body=body)

    # -- statements

    def block(self) -> dict:
        start = self.at
        self.take("{")
        self.scopes.append({})
        out = []
        while not self.accept("}"):
            out.append(self.statement())
        self.scopes.pop()
        return self.node("Block", start, statements=out)

    def statement(self) -> dict:
        start = self.at
        if self.peek() == "{":
            return self.block()
        if self.accept("unchecked"):
            return self.block() | {"nodeType": "UncheckedBlock"}
        if self.accept("if"):
            self.take("(")
            condition = self.expression()
            self.take(")")
            then = self.statement()
            other = self.statement() if self.accept("else") else None
            return self.node("IfStatement", start, condition=condition, trueBody=then, falseBody=other)
        if self.accept("while"):
            self.take("(")
            condition = self.expression()
            self.take(")")
            return self.node("WhileStatement", start, condition=condition, body=self.statement())
        if self.accept("return"):
            value = None if self.peek() == ";" else self.expression()
            self.take(";")
            return self.node("Return", start, expression=value)
        if self.accept("emit"):
            value = self.expression()
            self.take(";")
            return self.node("EmitStatement", start, eventCall=value)
        if self.accept("_"):
            self.take(";")
            return self.node("PlaceholderStatement", start)
        if self._declares():
            return self.declaration(start)
        value = self.expression()
        self.take(";")
        return self.node("ExpressionStatement", start, expression=value)

    def _declares(self) -> bool:
        if self.peek() == "(":
            return bool(_ELEMENTARY.match(self.peek(1)) and self.peek(2) not in ("(", ")")) or (self.peek(1) == "," and bool(_ELEMENTARY.match(self.peek(2))))
        named = _ELEMENTARY.match(self.peek()) or self.peek() in self.contracts or self.peek() == "mapping"
        return bool(named) and self.peek(1) not in ("(", ".", ")", ";", "=")

    def declaration(self, start: int) -> dict:
        found: list = []
        if self.accept("("):
            while not self.accept(")"):
                if self.peek() in (",", ")"):
                    found.append(None)
                else:
                    found.append(self._local())
                if self.accept(",") and self.peek() == ")":
                    found.append(None)
        else:
            found.append(self._local())
        # The initializer sees the scope without the new names.
        names = {d["name"]: self.scopes[-1].pop(d["name"]) for d in found if d}
        value = self.expression() if self.accept("=") else None
        self.scopes[-1].update(names)
        self.take(";")
        return self.node("VariableDeclarationStatement", start, declarations=found, initialValue=value)

    def _local(self) -> dict:
        start, kind = self.at, self.type_name()
        where = self.accept("memory", "storage", "calldata") or "default"
        return self._variable(start, self.take(), kind, storageLocation=where)

    # -- expressions

    def expression(self) -> dict:
        start, left = self.at, self.binary(0)
        op = self.accept("=", "+=", "-=", "*=", "/=", "%=")
        if op:
            return self.node("Assignment", start, operator=op, leftHandSide=left, rightHandSide=self.expression(), typeDescriptions=left.get("typeDescriptions", {}))
        return left

    def binary(self, level: int) -> dict:
        if level == len(_LEVELS):
            return self.unary()
        start, left = self.at, self.binary(level + 1)
        while op := self.accept(*_LEVELS[level]):
            left = self.node("BinaryOperation", start, operator=op, leftExpression=left, rightExpression=self.binary(level + 1), typeDescriptions={"typeString": "bool" if level < 4 else "uint256"})
        return left

    def unary(self) -> dict:
        start, op = self.at, self.accept("!", "-", "++", "--", "delete")
        if op:
            return self.node("UnaryOperation", start, operator=op, prefix=True, subExpression=self.unary(), typeDescriptions={"typeString": "bool"})
        return self.postfix()

    def arguments(self, end: str) -> list[dict]:
        out = []
        while not self.accept(end):
            out.append(self.expression())
            self.accept(",")
        return out

    def postfix(self) -> dict:
        start, e = self.at, self.primary()
        while True:
            kind = e.get("typeDescriptions", {}).get("typeString", "")
            if self.accept("["):
                index = self.expression()
                self.take("]")
                inner = kind[kind.index("=> ") + 3 : -1] if kind.startswith("mapping") else kind.removesuffix("[]")
                e = self.node("IndexAccess", start, baseExpression=e, indexExpression=index, typeDescriptions={"typeString": inner})
            elif self.accept("."):
                e = self._member(start, e, kind)
            elif self.peek() == "{" and e["nodeType"] == "MemberAccess" and self.peek(2) == ":":
                self.take("{")
                names, options = [], []
                while not self.accept("}"):
                    names.append(self.take())
                    self.take(":")
                    options.append(self.expression())
                    self.accept(",")
                e = self.node("FunctionCallOptions", start, expression=e, names=names, options=options, typeDescriptions=e.get("typeDescriptions", {}))
            elif self.accept("("):
                converts = e["nodeType"] == "ElementaryTypeNameExpression" or (e["nodeType"] == "Identifier" and e["name"] in self.contracts)
                arguments = self.arguments(")")
                result = e["typeName"]["name"] if "typeName" in e else e.get("name", "") if converts else ""
                e = self.node("FunctionCall", start, kind="typeConversion" if converts else "functionCall", expression=e, arguments=arguments, names=[], typeDescriptions={"typeString": result})
            elif self.peek() in ("++", "--"):
                e = self.node("UnaryOperation", start, operator=self.take(), prefix=False, subExpression=e, typeDescriptions={})
            else:
                return e

    def _member(self, start: int, e: dict, kind: str) -> dict:
        name = self.take()
        base = e.get("name") if e["nodeType"] == "Identifier" and e.get("referencedDeclaration", -1) < 0 else None
        types = {("msg", "sender"): "address", ("tx", "origin"): "address"}.get((base, name), "")
        described = {"typeString": types or ("uint256" if base else "")}
        if kind.startswith("address") and name in _BARE:
            described["typeIdentifier"] = f"t_function_{_BARE[name]}$_t_bytes_memory_ptr_$returns$"
        elif kind in self.contracts and name in self.contracts[kind]:
            described["typeIdentifier"] = f"t_function_external_{self.contracts[kind][name]}$__$returns$"
        return self.node("MemberAccess", start, memberName=name, expression=e, typeDescriptions=described)

    def primary(self) -> dict:
        kind, text, start, _ = self.tokens[self.i]
        if text == "(" and kind == "op":
            self.take()
            parts: list = []
            while not self.accept(")"):
                parts.append(None if self.peek() == "," else self.expression())
                if self.accept(",") and self.peek() == ")":
                    parts.append(None)
            return self.node("TupleExpression", start, components=parts, typeDescriptions=(parts[0] or {}).get("typeDescriptions", {}) if len(parts) == 1 else {})
        self.take()
        if kind in ("num", "hex"):
            number = int(text.replace("_", ""), 0)
            unit = self.accept(*_UNITS)
            number *= _UNITS[unit] if unit else 1
            return self.node("Literal", start, kind="number", value=text, typeDescriptions={"typeIdentifier": f"t_rational_{number}_by_1", "typeString": f"int_const {number}"})
        if kind == "str":
            return self.node("Literal", start, kind="string", value=text[1:-1], typeDescriptions={"typeIdentifier": "t_stringliteral", "typeString": "literal_string"})
        if text in ("true", "false"):
            return self.node("Literal", start, kind="bool", value=text, typeDescriptions={"typeIdentifier": "t_bool", "typeString": "bool"})
        if kind != "id":
            raise Unsupported(f"unexpected {text!r}")
        if _ELEMENTARY.match(text) or text == "payable":
            return self.node("ElementaryTypeNameExpression", start, typeName={"name": "address payable" if text == "payable" else text}, typeDescriptions={"typeString": f"type({text})"})
        known = next((s[text] for s in reversed(self.scopes) if text in s), None)
        described = {"typeString": known[1] if known else ""}
        if known and known[1] == "event":
            described = {"typeIdentifier": "t_function_event_nonpayable$__$returns$", "typeString": "event"}
        elif known is None and text in self.contracts.get(self.contract, {}):
            described = {"typeIdentifier": "t_function_internal_nonpayable$__$returns$", "typeString": "function"}
        return self.node("Identifier", start, name=text, referencedDeclaration=known[0] if known and known[0] else -1, typeDescriptions=described)


def compile_source(source: str, file: str) -> str:
    """The compiler output for one file, as JSON text; what can't be read is an error in it."""
    try:
        return json.dumps({"errors": [], "sources": {file: {"ast": _Parser(source).unit()}}})
    except (Unsupported, RecursionError) as e:
        return json.dumps({"errors": [{"severity": "error", "message": str(e)}], "sources": {}})
