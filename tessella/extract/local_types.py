"""Types that one file tells by itself: written annotations, literals and new objects.

It stands in for a compiler where no other file and no inference is needed. A name
counts only where every binding of it in the file has a known type or lies in
another scope, and a nullable name only where nothing before could have narrowed
it; for anything else no fact is made, so no rule reports on a guess.
"""

from __future__ import annotations

from typing import Any

from tessella.extract.lexer import IDENT, NUMBER, STRING, TEMPLATE

_PLAIN = {"string", "number", "boolean", "bigint", "symbol", "null", "undefined", "void", "any", "unknown"}
_OBJECTS = {"Array", "ReadonlyArray", "Map", "Set", "WeakMap", "WeakSet", "Date", "RegExp", "Record", "Error", "Promise", "PromiseLike"}
_NULLISH = {"null", "undefined", "void"}
#: What may stand before a name that is a whole operand of ??, || or &&.
_BEFORE = {"(", "=", ",", "return", "=>", "[", ";", "{", "}", ":", "?", "&&=", "||=", "??=", "await"}
_MEMBER = {".", "?.", "(", "[", "!", "`"}

Part = dict[str, Any]


def part(flag: str, calls: int = 0, literal: str | None = None) -> Part:
    return {"flag": flag, "n_props": 0, "n_calls": calls, "n_constructs": 0, "has_str_index": False, "has_num_index": False, "literal": literal}


class LocalTypes:
    def __init__(self, facts):
        self.f, self.t = facts, facts.t
        self.classes = {self.t[i + 1].text for i in range(len(self.t) - 1) if self.t[i].text in ("class", "interface", "enum") and self.t[i].kind == IDENT and self.t[i + 1].kind == IDENT and not facts.is_(i - 1, ".")}
        self.enums = {self.t[i + 1].text for i in range(len(self.t) - 1) if self.t[i].text == "enum" and self.t[i + 1].kind == IDENT}
        self.bound: dict[str, list[tuple[int, int, list[Part] | None, bool]]] = {}  # name: (from, to, parts, thenable)

    # -- types ------------------------------------------------------------

    def parts(self, i: int, j: int) -> tuple[list[Part], bool] | None:
        """Members of the type at tokens i .. j - 1 and whether one of them is a promise; None where the file doesn't tell."""
        f, out, thenable, a = self.f, [], False, i + self.f.is_(i, "|")
        while a < j:
            b, depth = a, 0
            while b < j and not (f.is_(b, "|") and depth == 0):
                if f.match.get(b, -1) > b:
                    b = f.match[b]
                elif f.is_(b, "<"):
                    b = max(f.after_angle(b), b + 1) - 1
                elif f.is_(b, "&", "extends", "=>", "is", "keyof", "typeof", "infer"):
                    return None
                b += 1
            one = self.one(a, min(b, j))
            if one is None:
                return None
            out.append(one[0])
            thenable |= one[1]
            a = b + 1
        return (out, thenable) if out else None

    def one(self, a: int, b: int) -> tuple[Part, bool] | None:
        f, t = self.f, self.t[a]
        if b - a == 1:
            if t.kind == STRING:
                return part("string-literal", literal=t.text[1:-1]), False
            if t.kind == NUMBER:
                return part("number-literal", literal=t.text), False
            if t.text in ("true", "false"):
                return part("boolean-literal", literal=t.text), False
            if t.text in _PLAIN:
                return part(t.text), False
            if t.text == "object" or (t.text in self.classes and t.text not in self.enums) or t.text in ("Date", "RegExp", "Error"):
                return part("object"), False
            return None
        if b - a >= 3 and f.is_(b - 1, "]") and f.is_(b - 2, "["):
            return part("array"), False
        if f.is_(a, "{") and f.match.get(a) == b - 1:
            return part("object"), False
        if t.kind == IDENT and t.text in _OBJECTS and f.is_(a + 1, "<") and f.after_angle(a + 1) == b:
            return part("array" if t.text.endswith("Array") else "object"), t.text.startswith("Promise")
        return None

    def value(self, i: int, j: int) -> tuple[list[Part], bool] | None:
        """The type of a literal or of a new object at tokens i .. j - 1."""
        f, t = self.f, self.t[i]
        if j - i == 1:
            if t.kind in (STRING, TEMPLATE):
                return [part("string-literal" if t.kind == STRING else "string", literal=t.text[1:-1] if t.kind == STRING else None)], False
            if t.kind == NUMBER:
                return [part("number-literal", literal=t.text)], False
            if t.text in ("true", "false"):
                return [part("boolean-literal", literal=t.text)], False
        if f.is_(i, "[", "{") and f.match.get(i) == j - 1:
            return [part("array" if t.text == "[" else "object")], False
        if t.text == "new" and j - i >= 4 and self.t[i + 1].kind == IDENT and f.is_(j - 1, ")") and f.match.get(j - 1) == i + 2:
            return [part("object")], self.t[i + 1].text.startswith("Promise")
        return None

    # -- bindings ---------------------------------------------------------

    def bind(self, name: str, scope: tuple[int, int], known: tuple[list[Part], bool] | None) -> None:
        self.bound.setdefault(name, []).append((*scope, *(known or (None, False))))

    def scope(self, i: int) -> tuple[int, int]:
        p = self.f.parent[i]
        return (p, self.f.match[p]) if p >= 0 and p in self.f.match else (-1, len(self.t))

    def collect(self) -> None:
        f = self.f
        for name, kind, optional, default, lo, hi in f.typed:
            known = self.parts(*kind) if kind else None
            if known and optional and not default:
                known = [*known[0], part("undefined")], known[1]
            self.bind(name, (lo, hi), known)
        for i, t in enumerate(self.t):
            if t.kind != IDENT or f.is_(i - 1, ".", "?."):
                continue
            if t.text in ("const", "let", "var") and i + 1 < len(self.t):
                if self.t[i + 1].kind == IDENT:
                    j, known = i + 2, None
                    if f.is_(j, ":"):
                        stop = f.skip_type(j + 1, {"=", ";", ","})
                        known = self.parts(j + 1, stop)
                    elif f.is_(j, "=") and t.text == "const":
                        known = self.value(j + 1, f.expression_end(j + 1, {";", ",", ")", "}"}))
                    # in the head of a loop, or declared with others: not followed here
                    self.bind(self.t[i + 1].text, self.scope(i) if not f.is_(f.parent[i], "(") else (-1, len(self.t)), known if not f.is_(f.parent[i], "(") else None)
                elif i + 1 in f.match:
                    self.unknown(i + 1)
            elif f.is_(i + 1, "=>") or f.is_(i - 1, "catch", "function", "class", "enum", "namespace") or f.is_(i - 2, "catch") and f.is_(i - 1, "("):
                self.bind(t.text, (-1, len(self.t)), None)
            elif t.text == "import":
                k = i + 1
                while k < len(self.t) and not f.is_(k, "from", ";", "("):
                    if self.t[k].kind == IDENT:
                        self.bind(self.t[k].text, (-1, len(self.t)), None)
                    k += 1

    def unknown(self, open_: int) -> None:
        """Every name of a pattern."""
        for k in range(open_ + 1, self.f.match[open_]):
            if self.t[k].kind == IDENT:
                self.bind(self.t[k].text, (-1, len(self.t)), None)

    def known(self, i: int) -> tuple[list[Part], bool] | None:
        """The type of the name at i by its innermost binding; None where any other binding could be meant."""
        mine = [b for b in self.bound.get(self.t[i].text, []) if b[0] <= i < b[1]]
        if not mine or any(b[2] is None for b in mine):
            return None
        best = min(mine, key=lambda b: b[1] - b[0])
        if sum(b[:2] == best[:2] for b in mine) > 1:
            return None
        if any(p["flag"] in _NULLISH for p in best[2]) and any(self.t[k].text == self.t[i].text and self.t[k].kind == IDENT and not self.f.is_(k + 1, ":", "?", "!") and not self.f.is_(k - 1, ".") for k in range(max(best[0], 0), i)):
            return None  # it may have been tested or assigned before
        return best[2], best[3]

    # -- facts ------------------------------------------------------------

    def emit(self, kind: str, i: int, j: int, parts: list[Part], **more: Any) -> None:
        self.f.expr(kind, i, j, **more)
        self.f.out["expr_facts"][-1]["type_parts"] = parts

    def run(self) -> None:
        self.collect()
        f = self.f
        for i, t in enumerate(self.t[:-1]):
            if t.kind != IDENT or t.text not in self.bound or f.is_(i - 1, ".", "?.") or (found := self.known(i)) is None:
                continue
            parts, thenable = found
            loose = any(p["flag"] in ("any", "unknown") for p in parts)  # it may be null as well as anything
            after = self.t[i + 1].text if self.t[i + 1].kind != STRING and not loose else ""
            if after == "!" and not self.t[i + 1].newline and i + 2 < len(self.t) and f.is_(i + 2, ".", ")", ";", ",", "]", "[", "}", "("):
                self.emit("NonNull", i, i + 2, parts, operand=t.text)
            elif after == "?." and i + 2 < len(self.t):
                q, what = self.t[i + 1], {"[": "ElementAccess", "(": "CallExpression"}.get(self.t[i + 2].text, "PropertyAccess")
                self.emit(what, i, i + 3, parts, operand=t.text, flags={"has_qdot": True}, attrs={"qdot_start": str(q.start), "qdot_end": str(q.end)})
            elif after in ("??", "||", "&&") and (i == 0 or self.t[i - 1].text in _BEFORE and not f.is_(i - 1, "await")) and i + 2 < len(self.t):
                end = f.expression_end(i + 2, {";", ",", ")", "]", "}", ":"})
                right = self.t[i + 2]
                flags = {"rhs_literal": end - i == 3 and (right.kind in (STRING, NUMBER, TEMPLATE) or right.text in ("true", "false"))}
                attrs = {"rhs_text": right.text} | ({"guard_ident": t.text, "rhs_root": right.text} if after == "&&" and f.is_(i + 3, ".") else {})
                self.emit("Binary", i, max(end, i + 3), parts, op=after, operand=t.text, flags=flags, attrs=attrs)
            whole = self.t[i + 1].text not in _MEMBER
            if f.is_(i - 1, "await") and whole:
                self.emit("Await", i - 1, i + 1, parts, operand=t.text, flags={"has_then": thenable or any(p["flag"] == "object" for p in parts)})
            if whole and (f.is_(i - 1, "!") and f.is_(i - 2, "!") or f.is_(i - 1, "!!")):
                self.emit("DoubleNegation", i - (1 if f.is_(i - 1, "!!") else 2), i + 1, parts, operand=t.text)
