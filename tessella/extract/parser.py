"""Syntactic facts of one TypeScript file.

No grammar is built: brackets are matched once, and every fact is a pattern over
the token stream and the bracket tree. That reads the constructs that the
syntax-only rules need; JSX text is read as ordinary tokens.
"""

from __future__ import annotations

import re
from typing import Any

from tessella.extract.local_types import LocalTypes
from tessella.extract.lexer import IDENT, NUMBER, PUNCT, REGEX, STRING, TEMPLATE, Comment, Token, token_text, tokenize

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_CONTINUES = {".", "?.", "+", "-", "*", "/", "%", "**", "&&", "||", "??", "?", ":", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&", "|", "^", ",", ")", "]", "}", "=>", "+=", "-=", "*=", "/=", "??=", "||=", "&&=", "instanceof", "in", "as", "satisfies", "[", "("}
_NEEDS_MORE = {"+", "-", "*", "/", "%", "**", "&&", "||", "??", "?", ":", "=", "==", "===", "!=", "!==", "<", "<=", ">=", "&", "|", "^", ",", "(", "[", "{", "=>", "+=", "-=", "??=", "||=", "&&=", ".", "?.", "!", "~", "typeof", "new", "await", "in", "instanceof", "as", "extends", "keyof"}
_KEYWORDS = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static await async of as is".split())
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "super", "import", "await", "void", "delete", "throw", "in", "of", "instanceof", "with", "constructor", "do", "else", "yield", "case"}
_CONTROL = {"if", "switch", "try", "for", "while", "do"}
_LITERAL = {STRING, NUMBER, TEMPLATE}


class Facts:
    def __init__(self, source: str):
        self.src = source
        self.t, self.comments = tokenize(source)
        self.match = self._brackets()
        self.parent = self._parents()
        self.out: dict[str, list[dict[str, Any]]] = {k: [] for k in ("types", "functions", "constants", "inline_param_types", "call_sites", "imports", "statements", "comments", "literal_props", "return_shapes", "ident_counts", "expr_facts")}
        self.seq = 0
        self.bodies: dict[int, int] = {}  # opening brace of a function body -> index into functions
        self.scopes: list[tuple[int, int]] = []  # token ranges of function bodies
        self.typed: list[tuple] = []  # parameters: name, token range of the type, optional, with a default, body

    # -- structure --------------------------------------------------------

    def _brackets(self) -> dict[int, int]:
        stack, match = [], {}
        for i, t in enumerate(self.t):
            if t.kind != PUNCT:
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE and stack and _OPEN[self.t[stack[-1]].text] == t.text:
                j = stack.pop()
                match[i], match[j] = j, i
        return match

    def _parents(self) -> list[int]:
        """For each token the opening bracket that encloses it, -1 at the top."""
        out, stack = [], []
        for i, t in enumerate(self.t):
            if i in self.match and self.match[i] < i and stack:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            if i in self.match and self.match[i] > i:
                stack.append(i)
        return out

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in (PUNCT, IDENT) and self.t[i].text in texts

    def text(self, i: int, j: int) -> str:
        """Source of tokens i .. j - 1."""
        return self.src[self.t[i].start : self.t[j - 1].end] if i < j else ""

    def after_angle(self, i: int) -> int:
        """The token after a type parameter list that begins at i, or i if there is none."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.t):
            x = self.t[j].text
            if x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
                if depth <= 0:
                    return j + 1
            elif x in _OPEN and j in self.match:
                j = self.match[j]
            elif x in (";", ")", "]", "}"):
                return i
            j += 1
        return i

    def skip_type(self, i: int, stops: set[str]) -> int:
        """The end of a type that begins at i: the first token at depth 0 that can't belong to it."""
        j, want = i, True
        while j < len(self.t):
            t = self.t[j]
            if t.kind == PUNCT and t.text in stops and not (want and t.text in ("{", "(", "[")):
                return j
            if t.newline and not want and not (t.kind == PUNCT and t.text in ("|", "&", "=>", "[")):
                return j
            if t.text in ("|", "&", "=>", "?", ":") or (t.kind == IDENT and t.text in ("keyof", "typeof", "readonly", "infer", "extends", "is", "asserts", "unique", "new")):
                want = True
                j += 1
                continue
            if t.kind == PUNCT and t.text in _OPEN and j in self.match:
                if t.text == "{" and not want:
                    return j
                j = self.match[j] + 1
                want = False
                continue
            if t.text == "<":
                k = self.after_angle(j)
                if k == j:
                    return j
                j = k
                continue
            if t.text == ".":
                want = True
                j += 1
                continue
            if t.kind in (IDENT, STRING, NUMBER, TEMPLATE) or t.text == "-":
                if not want and t.kind == IDENT:
                    return j
                want = t.text == "-"
                j += 1
                continue
            return j
        return j

    def expression_end(self, i: int, stops: set[str]) -> int:
        """The end of an expression from i at the same depth."""
        j = i
        while j < len(self.t):
            t = self.t[j]
            if t.kind == PUNCT and t.text in stops:
                return j
            if j > i and t.newline and self.breaks(j):
                return j
            j = self.match[j] + 1 if j in self.match and self.match[j] > j else j + 1
            if j - 1 < len(self.t) and self.t[j - 1].text in _CLOSE and (j - 1) not in self.match:
                return j - 1
        return j

    def breaks(self, j: int) -> bool:
        """Whether the line break before token j ends a statement."""
        before, now = self.t[j - 1], self.t[j]
        if before.kind in (PUNCT, IDENT) and before.text in _NEEDS_MORE:
            return False
        return not (now.kind in (PUNCT, IDENT) and now.text in _CONTINUES) and now.kind != TEMPLATE

    def statement_end(self, i: int, limit: int) -> int:
        """The token after the statement that begins at i."""
        if i >= limit:
            return limit
        t = self.t[i]
        word = t.text if t.kind in (IDENT, PUNCT) else ""
        group = lambda k: self.match.get(k, k) + 1 if self.is_(k, "(", "{", "[") else k
        if word == "{":
            return group(i)
        if word == ";":
            return i + 1
        if word == "if":
            j = self.statement_end(group(i + 1), limit)
            return self.statement_end(j + 1, limit) if j < limit and self.is_(j, "else") else j
        if word in ("for", "while", "with"):
            j = i + 1 + (self.is_(i + 1, "await"))
            return self.statement_end(group(j), limit)
        if word == "do":
            j = self.statement_end(i + 1, limit)
            j = group(j + 1) if self.is_(j, "while") else j
            return j + 1 if self.is_(j, ";") else j
        if word == "try":
            j = group(i + 1)
            while j < limit and self.is_(j, "catch", "finally"):
                j = group(group(j + 1))
            return j
        if word == "switch":
            return group(group(i + 1))
        if word in ("function", "class", "interface", "enum", "namespace", "abstract", "declare") or (word == "async" and self.is_(i + 1, "function")):
            j = i
            while j < limit and not self.is_(j, "{", ";"):
                j = group(j) if self.is_(j, "(", "[") else j + 1
            if j < limit and self.is_(j, "{"):
                j = group(j)
                while j < limit and word == "function" and self.is_(j, "{"):
                    j = group(j)
                return j
            return min(limit, j + 1)
        j = self.expression_end(i, {";"})
        return min(limit, j + 1 if self.is_(j, ";") else max(j, i + 1))

    # -- functions --------------------------------------------------------

    def params(self, open_: int) -> list[dict[str, Any]]:
        out, i, end = [], open_ + 1, self.match.get(open_, open_)
        while i < end:
            j = i
            while j < end and not self.is_(j, ","):
                k = self.after_angle(j) if self.is_(j, "<") else j
                j = k if k > j else self.match[j] + 1 if j in self.match and self.match[j] > j else j + 1
            a = i
            while a < j and (self.is_(a, "public", "private", "protected", "readonly", "override") and a + 1 < j and not self.is_(a + 1, ":", "?", "=", ",") or self.is_(a, "@")):
                a += 2 if self.is_(a, "@") else 1
            rest = self.is_(a, "...")
            a += rest
            if a < j:
                e = self.match[a] + 1 if self.is_(a, "{", "[") and a in self.match else a + 1
                optional = self.is_(e, "?")
                k = e + optional
                kind = None
                if self.is_(k, ":"):
                    stop = self.skip_type(k + 1, {",", "=", ")"})
                    kind = (k + 1, min(stop, j))
                    k = stop
                out.append({"name": self.text(a, e), "optional": optional, "has_default": k < j and self.is_(k, "="), "type_text": self.text(*kind) if kind else None, "_rest": rest, "_type": kind, "_at": a})
            i = j + 1
        return out

    def add_function(self, name: str, at: int, open_: int | None, params: list[dict[str, Any]], body: tuple[int, int], is_expr: bool, node_kind: str, exported: bool = False, default: bool = False, class_name: str | None = None, iface: bool = False, type_params: int = 0, predicate: bool = False) -> None:
        lo, hi = body
        raw = self.text(lo, hi)
        inner = [x.text for x in self.t[lo:hi] if x.kind == IDENT]
        stmts = self.statements_of(lo) if not is_expr else []
        n_top = 1 if is_expr else len(stmts)
        a, b = (lo, hi) if is_expr else (stmts[0] if len(stmts) == 1 else (0, 0))
        if not is_expr and len(stmts) == 1 and self.is_(a, "return"):
            a += 1
        if b > a and self.is_(b - 1, ";"):
            b -= 1
        call, args = None, None
        if b - a >= 3 and self.is_(b - 1, ")") and self.match.get(b - 1, -1) > a:
            o = self.match[b - 1]
            if all(x.kind == IDENT or x.text == "." for x in self.t[a:o]) and self.t[o - 1].kind == IDENT:
                call, args = f"{self.t[o - 1].start}", [self.text(x, y) for x, y in self.split(o)]
        t = self.t[at]
        self.bodies[lo] = len(self.out["functions"])
        self.scopes.append((lo, hi))
        self.out["functions"].append({
            "fn_id": str(t.start), "name": name, "line": t.line, "col": t.col, "tokens": token_text(raw), "params": [{k: p[k] for k in ("name", "optional", "has_default", "type_text")} for p in params], "exported": exported, "exported_default": default,
            "class_name": class_name, "implements_interface": iface, "has_rest": any(p["_rest"] for p in params), "node_kind": node_kind, "n_top_stmts": n_top, "is_expr_body": is_expr, "has_control_flow": any(x in _CONTROL for x in inner), "is_predicate": predicate,
            "n_type_params": type_params, "sole_call_id": call, "sole_call_args": args, "single_statement": n_top <= 1, "seq": self.seq,
        })
        self.seq += 1
        for p in params:
            for word in re.findall(r"[\w$]+", p["name"]):
                self.typed.append((word, p["_type"] if word == p["name"] and not p["_rest"] else None, p["optional"], p["has_default"], lo, hi))
            if p["_type"] and self.is_(p["_type"][0], "{") and self.match.get(p["_type"][0], -1) == p["_type"][1] - 1:
                o = self.t[p["_type"][0]]
                self.out["inline_param_types"].append({"line": o.line, "col": o.col, "members": self.members(p["_type"][0]), "type_text": self.text(*p["_type"]), "seq": self.seq})
            if p["optional"]:
                u = self.t[p["_at"]]
                self.expr("OptionalParam", p["_at"], p["_at"] + 1, attrs={"function": str(t.start), "name": p["name"]})
                if not is_expr:
                    self.param_use(str(t.start), p["name"], stmts, u)

    def param_use(self, fn: str, name: str, stmts: list[tuple[int, int]], at: Token) -> None:
        """How the first statement that mentions an optional parameter uses it."""
        for pos, (a, b) in enumerate(stmts):
            if not any(x.kind == IDENT and x.text == name for x in self.t[a:b]):
                continue
            words = [x.text for x in self.t[a:b]]
            use = "other"
            if words[:2] == [name, "??="] or (words[:2] == [name, "="] and words[2:4] == [name, "??"]):
                use = "assign-default"
            elif words[0] == "if" and self.is_(a + 1, "("):
                c = self.match.get(a + 1, a + 1)
                test = [x.text for x in self.t[a + 2 : c]]
                end = self.statement_end(c + 1, b)
                inner = self.statements_of(c + 1) if self.is_(c + 1, "{") else [(c + 1, end)]
                empty = len(test) == 3 and test[1] in ("===", "==") and any({test[0], test[2]} == {name, x} for x in ("undefined", "null"))
                if (empty or test == ["!", name]) and len(inner) == 1 and self.is_(inner[0][0], "throw"):
                    use = "guard-throw"
            self.expr("ParamUse", a, a + 1, attrs={"function": fn, "name": name, "pos": str(pos), "use": use})
            return

    def members(self, open_: int) -> list[dict[str, Any]]:
        """(name, optional, type_text) of the members of an object type; nested object types are made neutral."""
        out, i, end = [], open_ + 1, self.match.get(open_, open_)
        while i < end:
            j = i
            while j < end and not self.is_(j, ";", ","):
                if j > i and self.t[j].newline and not self.is_(j, "|", "&", "=>", ".", ")", ">") and self.t[j - 1].text not in ("|", "&", ":", "=>", ",", "<"):
                    break
                k = self.after_angle(j) if self.is_(j, "<") else j
                j = k if k > j else self.match[j] + 1 if j in self.match and self.match[j] > j else j + 1
            if j > i:
                a = i + (self.is_(i, "readonly") and j > i + 1 and not self.is_(i + 1, ":", "?"))
                e = self.match[a] + 1 if self.is_(a, "[", "(") and a in self.match else a + 1
                if self.is_(e, "?") or self.is_(e, ":"):
                    optional = self.is_(e, "?")
                    k = e + optional + 1
                    has_type = self.is_(e + optional, ":")
                    out.append({"name": self.text(a, e), "optional": optional, "type_text": self.type_form(k, j) if has_type else None, "method": False})
                else:
                    out.append({"name": re.sub(r"\s+", " ", self.text(i, j)).strip(), "optional": False, "type_text": "", "method": True})
            i = j + 1 if self.is_(j, ";", ",") else max(j, i + 1)
        return out

    def type_form(self, i: int, j: int) -> str:
        """A type's text; an object type as its sorted members."""
        if self.is_(i, "{") and self.match.get(i) == j - 1:
            return "{" + ";".join(sorted(m["name"] if m["method"] else f"{m['name']}{'?' if m['optional'] else ''}:{'any' if m['type_text'] is None else m['type_text']}" for m in self.members(i))) + "}"
        return re.sub(r"\s+", " ", self.text(i, j)).strip()

    def split(self, open_: int) -> list[tuple[int, int]]:
        """Token ranges of the comma-separated parts within a bracket."""
        out, i, end = [], open_ + 1, self.match.get(open_, open_)
        start = i
        while i < end:
            if self.is_(i, ","):
                out.append((start, i))
                start = i + 1
            i = self.match[i] + 1 if i in self.match and self.match[i] > i else i + 1
        return out + ([(start, end)] if start < end else [])

    def statements_of(self, open_: int) -> list[tuple[int, int]]:
        out, i, end = [], open_ + 1, self.match.get(open_, open_)
        while i < end:
            j = self.statement_end(i, end)
            if not self.is_(i, ";"):
                out.append((i, j))
            i = max(j, i + 1)
        return out

    def expr(self, kind: str, i: int, j: int, parent: str | None = None, op: str | None = None, operand: str | None = None, flags: dict[str, bool] | None = None, attrs: dict[str, str] | None = None) -> None:
        t = self.t[i]
        self.out["expr_facts"].append({"node_id": f"{kind}:{t.start}", "parent_id": parent, "kind": kind, "op": op, "start": t.start, "end": self.t[j - 1].end, "line": t.line, "col": t.col, "text": self.text(i, j)[:200], "operand_text": operand, "flags": flags or {}, "attrs": attrs or {}})

    def exported(self, i: int) -> tuple[bool, bool]:
        """Whether the declaration whose keyword is at i is exported, and by default."""
        j, default = i - 1, False
        while j >= 0 and self.is_(j, "async", "default", "abstract", "declare"):
            default |= self.is_(j, "default")
            j -= 1
        return self.is_(j, "export"), default and self.is_(j, "export")

    # -- the pass ---------------------------------------------------------

    def run(self) -> dict[str, list[dict[str, Any]]]:
        named = self.named_exports()
        classes: list[tuple[int, int, str, bool, bool]] = []
        for i, t in enumerate(self.t):
            if t.kind == IDENT and t.text == "class" and not self.is_(i - 1, "."):
                name = self.t[i + 1].text if i + 1 < len(self.t) and self.t[i + 1].kind == IDENT and not self.is_(i + 1, "extends", "implements") else "<anonymous>"
                j, iface = i + 1, False
                while j < len(self.t) and not self.is_(j, "{", ";"):
                    iface |= self.is_(j, "implements")
                    k = self.after_angle(j) if self.is_(j, "<") else j
                    j = k if k > j else self.match[j] + 1 if self.is_(j, "(") and j in self.match else j + 1
                before = i - 1
                declared = before < 0 or self.is_(before, "export", "default", "abstract", "declare", ";", "}", "{") or t.newline
                if self.is_(j, "{") and j in self.match and declared:
                    classes.append((j, self.match[j], name, iface, self.exported(i)[0] or name in named))
        for i, t in enumerate(self.t):
            if t.kind == IDENT:
                self.ident(i, t, classes, named)
            elif t.kind == PUNCT:
                if t.text == "=>":
                    self.arrow(i, named)
                elif t.text == "(":
                    self.call(i)
                elif t.text == "{":
                    self.brace(i)
                elif t.text == "<" and (i == 0 or self.t[i - 1].kind == PUNCT and self.t[i - 1].text not in (")", "]", "}")):
                    j = self.after_angle(i)
                    if j > i + 1 and j < len(self.t) and not self.is_(j, "(", ")", ",", ">") and self.is_(i + 1, "{"):
                        self.expr("TypeAssertion", i, j + 1, flags={"target_has_literal": True}, attrs={"target_kind": "object"})
        self.literals()
        LocalTypes(self).run()
        counts: dict[str, int] = {}
        for t in self.t:
            if t.kind == IDENT and t.text not in _KEYWORDS:
                counts[t.text] = counts.get(t.text, 0) + 1
        self.out["ident_counts"] = [{"ident": k, "n": n} for k, n in sorted(counts.items())]
        self.out["comments"] = [self.comment(c) for c in self.comments]
        return self.out

    def comment(self, c: Comment) -> dict[str, Any]:
        """A comment row; a compiler directive is at the start of a line comment, or of the last line of a block comment."""
        line = c.value if c.kind == "Line" else c.value.split("\n")[-1]
        m = re.match(r"^(?:/?\s*|\s*\**\s*)@ts-(ignore|expect-error)", line)
        return {"kind": c.kind, "value": c.value, "start": c.start, "end": c.end, "start_line": c.start_line, "end_line": c.end_line, "directive": {"ignore": "ignore", "expect-error": "expect"}[m[1]] if m else None}

    def named_exports(self) -> set[str]:
        """Names that an export list without a module gives out, or a default export of a name."""
        out = set()
        for i in range(len(self.t)):
            if not self.is_(i, "export") or self.parent[i] != -1:
                continue
            if self.is_(i + 1, "{") and i + 1 in self.match and not self.is_(self.match[i + 1] + 1, "from"):
                out |= {self.t[a + self.is_(a, "type")].text for a, b in self.split(i + 1) if a + self.is_(a, "type") < b}
            if self.is_(i + 1, "default") and i + 2 < len(self.t) and self.t[i + 2].kind == IDENT and (i + 3 >= len(self.t) or self.is_(i + 3, ";") or self.t[i + 3].newline):
                out.add(self.t[i + 2].text)
        return out

    def return_type(self, i: int) -> tuple[int, bool]:
        """(the token after a return type that begins with a colon at i, whether it is a predicate)."""
        if not self.is_(i, ":"):
            return i, False
        j = self.skip_type(i + 1, {"{", ";", "=>"})
        return j, any(self.is_(k, "is") for k in range(i + 1, j))

    def ident(self, i: int, t: Token, classes: list, named: set[str]) -> None:
        word, top = t.text, self.parent[i] == -1
        if self.is_(i - 1, ".", "?."):
            if word == "catch":
                self.promise_catch(i)
            return
        if word == "import" and top and not self.is_(i + 1, "(", "."):
            self.import_(i)
        elif word == "import" and self.is_(i + 1, "("):
            self.expr("CallExpression", i, self.match.get(i + 1, i + 1) + 1, attrs={"callee_kind": "import"})
        elif word == "export" and top:
            self.export(i)
        elif word == "interface" and i + 1 < len(self.t) and self.t[i + 1].kind == IDENT and not self.is_(i + 1, "extends", "in", "instanceof"):
            j = i + 2
            k = self.after_angle(j)
            n_params = len(self.split_angle(j, k))
            while k < len(self.t) and not self.is_(k, "{", ";"):
                k = max(self.after_angle(k), k + 1) if self.is_(k, "<") else k + 1
            if self.is_(k, "{") and k in self.match:
                self.add_type(i, self.t[i + 1].text, "InterfaceDeclaration", k, None, n_params, named)
        elif word == "type" and i + 1 < len(self.t) and self.t[i + 1].kind == IDENT and self.is_(i + 2, "=", "<") and not self.is_(i - 1, "import", "{", ","):
            self.alias(i, named)
        elif word == "function" and not (i + 1 < len(self.t) and self.is_(i + 1, ":", ",", ")", ";")):
            self.function(i, named)
        elif word in ("const", "let", "var") and i + 1 < len(self.t) and self.t[i + 1].kind == IDENT:
            self.variable(i, named)
        elif word == "any":
            before, ok = self.t[i - 1] if i else None, False
            if before is not None and before.text in (":", "<", "|", "&", "as", "=>", "keyof", "extends", ",", "is", "readonly", "(", "="):
                ok = not self.is_(i + 1, "(", ":", ".", "?.", "=>") and (before.text not in (",", "(", "=") or self.in_type(i))
            if ok:
                self.expr("AnyKeyword", i, i + 1, attrs={"parent_kind": "AsExpression" if before.text == "as" else "TypeNode"})
        elif word == "as" and i and not self.in_module_clause(i):
            before = self.t[i - 1]
            if (before.kind in (IDENT, STRING, NUMBER, TEMPLATE, REGEX) and before.text not in ("return", "typeof", "const") or before.text in (")", "]", "}", "!")) and i + 1 < len(self.t):
                self.as_(i)
        elif word == "catch":
            self.catch(i)
        for o, c, name, iface, exported in classes:
            if o < i < c and self.parent[i] == o:
                self.method(i, t, name, iface, exported)

    def in_module_clause(self, i: int) -> bool:
        p = self.parent[i]
        return self.is_(i - 1, "*") or (p >= 0 and (self.is_(p - 1, "import", "export", "type", ",") and (self.is_(self.match.get(p, p) + 1, "from") or self.is_(p - 1, "export"))))

    def in_type(self, i: int) -> bool:
        """Whether a bare name stands in a type: inside angle brackets or an alias."""
        if self.is_(i - 1, "="):
            return self.is_(i - 3, "type") or self.is_(i + 1, ";") and self.is_(i - 3, "type")
        j, depth = i - 1, 0
        while j >= 0 and i - j < 40:
            x = self.t[j].text
            if x == ">":
                depth += 1
            elif x == "<":
                if depth == 0:
                    return True
                depth -= 1
            elif x in (";", "{", "}"):
                return False
            j -= 1
        return False

    def split_angle(self, i: int, k: int) -> list[str]:
        inside = self.text(i + 1, k - 1) if k > i + 1 else ""
        return [p for p in inside.split(",") if p.strip()]

    def add_type(self, i: int, name: str, kind: str, open_: int | None, text: str | None, n_params: int, named: set[str], n_args: int = 0) -> None:
        ms = self.members(open_) if open_ is not None else []
        t = self.t[i]
        self.out["types"].append({"name": name, "line": t.line, "col": t.col, "members": ms if open_ is not None else None, "shape_text": text, "node_kind": kind, "n_members": len(ms), "prop_names": [m["name"] for m in ms if not m["method"]], "exported": self.exported(i)[0] or name in named, "n_type_params": n_params, "n_type_args": n_args, "seq": self.seq})
        self.seq += 1

    def alias(self, i: int, named: set[str]) -> None:
        k = self.after_angle(i + 2)
        if not self.is_(k, "="):
            return
        end = self.skip_type(k + 1 + self.is_(k + 1, "|"), {";"})
        a = k + 1
        n_params = len(self.split_angle(i + 2, k))
        if self.is_(a, "{") and self.match.get(a) == end - 1:
            self.add_type(i, self.t[i + 1].text, "TypeLiteral", a, None, n_params, named)
            return
        bare = end > a and all(x.kind == IDENT or x.text == "." for x in self.t[a:end]) and not self.is_(a, "keyof", "typeof", "readonly", "any", "unknown", "never", "string", "number", "boolean", "void", "null", "undefined", "object", "symbol", "bigint", "true", "false", "unique", "infer")
        angle = a + 1 < end and self.is_(a + 1, "<") and self.after_angle(a + 1) == end
        kind = "TypeReference" if bare or angle else "Other"
        self.add_type(i, self.t[i + 1].text, kind, None, re.sub(r"\s+", " ", self.text(a, end)).strip(), n_params, named, len(self.split_angle(a + 1, end)) if angle else 0)

    def body_at(self, j: int) -> tuple[tuple[int, int], bool] | None:
        """((first, last + 1) of a body at j, whether it is an expression)."""
        if self.is_(j, "{") and j in self.match:
            return (j, self.match[j] + 1), False
        end = self.expression_end(j, {";", ",", ")", "]", "}"})
        return ((j, end), True) if end > j else None

    def function(self, i: int, named: set[str]) -> None:
        j = i + 1 + self.is_(i + 1, "*")
        name = self.t[j].text if j < len(self.t) and self.t[j].kind == IDENT else None
        j += name is not None
        k = self.after_angle(j)
        if not self.is_(k, "(") or k not in self.match:
            return
        ps = self.params(k)
        b, predicate = self.return_type(self.match[k] + 1)
        if not self.is_(b, "{") or b not in self.match:
            return
        body = (b, self.match[b] + 1)
        start = i - 1 if self.is_(i - 1, "async") else i
        declaration = name is not None and (start == 0 or self.t[start].newline or self.is_(start - 1, ";", "}", "{", "export", "default")) and not self.is_(start - 1, "=", "(", ",", ":", "return")
        n_params = len(self.split_angle(j, k))
        if declaration:
            ex, default = self.exported(start)
            self.add_function(name, start, k, ps, body, False, "FunctionDeclaration", ex or name in named, default, type_params=n_params, predicate=predicate)
        else:
            self.nested(start, k, ps, body, False, "FunctionExpression", n_params, predicate, named)

    def nested(self, start: int, open_: int, ps: list, body: tuple[int, int], is_expr: bool, kind: str, n_params: int, predicate: bool, named: set[str]) -> None:
        """An arrow or a function expression: named by its variable or property, else anonymous if its body is long enough."""
        b = start - 1
        more = {"type_params": n_params, "predicate": predicate}
        if self.is_(b, "="):
            v = self.variable_before(b)
            if v is not None:
                ex, default = self.exported(v - 1)
                name = self.t[v].text
                self.add_function(name, v, open_, ps, body, is_expr, kind, ex or name in named, default, **more)
                return
        if self.is_(b, ":") and b and self.t[b - 1].kind in (IDENT, STRING) and self.is_(b - 2, "{", ","):
            self.add_function(self.t[b - 1].text.strip("\"'"), b - 1, open_, ps, body, is_expr, kind, **more)
            return
        if len(token_text(self.text(*body))) < 64:
            return
        p = self.parent[start]
        name = f"<anonymous>:{self.t[start].line}"
        if p >= 0 and self.is_(p, "(") and p and self.t[p - 1].kind == IDENT:
            o = p - 1
            while self.is_(o - 1, ".", "?.") and o - 2 >= 0 and self.t[o - 2].kind == IDENT:
                o -= 2
            if self.is_(o - 1, ":") and o - 2 >= 0 and self.t[o - 2].kind == IDENT and self.is_(o - 3, "{", ","):
                name = self.t[o - 2].text
            else:
                n = next((k for k, (x, y) in enumerate(self.split(p)) if x <= start < y), 0)
                name = f"{self.t[p - 1].text}.$arg{n}"
        self.add_function(name, start, open_, ps, body, is_expr, kind, **more)

    def variable_before(self, eq: int) -> int | None:
        """The name that a declaration with its = at eq declares."""
        j = eq - 1
        while j >= 0 and self.parent[j] == self.parent[eq] and not self.is_(j, ";", "const", "let", "var", "{", "}", "=>"):
            j = self.match[j] - 1 if j in self.match and self.match[j] < j else j - 1
        if self.is_(j, "=>"):
            while j >= 0 and not self.is_(j, ";", "const", "let", "var"):
                j -= 1
        return j + 1 if j >= 0 and self.is_(j, "const", "let", "var") and self.t[j + 1].kind == IDENT and (j + 2 == eq or self.is_(j + 2, ":")) else None

    def arrow(self, i: int, named: set[str]) -> None:
        """A function whose => is at i; in a type there is no body to find."""
        j = i - 1
        predicate, n_params = False, 0
        if not (self.is_(j, ")") and j in self.match):
            k = j  # walk back over a return type
            while k > 0 and not (self.is_(k, ")") and k in self.match and self.is_(k + 1, ":")):
                if self.is_(k, ";", "=", "{", ",") or self.parent[k] != self.parent[i]:
                    k = -1
                    break
                k = self.match[k] - 1 if k in self.match and self.match[k] < k else k - 1
            if k > 0:
                predicate = any(self.is_(x, "is") for x in range(k, i))
                j = k
        if self.is_(j, ")") and j in self.match:
            open_ = self.match[j]
            ps, start = self.params(open_), open_
            if self.is_(start - 1, ">"):
                k = start - 1
                while k > 0 and not self.is_(k, "<"):
                    k -= 1
                n_params, start = len(self.split_angle(k, start)), k
        elif self.t[j].kind == IDENT and self.t[j].text not in _KEYWORDS:
            open_, start = j, j
            ps = [{"name": self.t[j].text, "optional": False, "has_default": False, "type_text": None, "_rest": False, "_type": None, "_at": j}]
        else:
            return
        if self.is_(start - 1, "async"):
            start -= 1
        before = self.t[start - 1] if start else None
        if before is not None and before.text in (":", "|", "&", "<", "=>") and not self.property_value(start - 1) and before.text != "=>":
            return
        if before is not None and before.text == "=" and self.is_(start - 3, "type"):
            return
        b = self.body_at(i + 1)
        if b is not None:
            self.nested(start, open_, ps, b[0], b[1], "ArrowFunction", n_params, predicate, named)
            if b[1] and self.is_(i + 1, "(") and self.is_(i + 2, "{") and self.match.get(i + 2) == self.match.get(i + 1, 0) - 1:
                self.shape(i + 2, self.t[start], f"<anonymous>:{self.t[start].line}")

    def property_value(self, colon: int) -> bool:
        """Whether a colon separates a property from its value, or the arms of a conditional."""
        p = self.parent[colon]
        if p >= 0 and self.is_(p, "{") and self.is_(colon - 2, "{", ","):
            return not self.type_brace(p)
        k = colon - 1
        while k > p and self.parent[k] == p and not self.is_(k, ";", ",", "{"):
            if self.is_(k, "?") and k + 1 < colon:
                return True
            k = self.match[k] - 1 if k in self.match and self.match[k] < k else k - 1
        return False

    def type_brace(self, open_: int) -> bool:
        b = self.t[open_ - 1] if open_ else None
        if b is None:
            return False
        if b.text in (":", "|", "&", "<") and not self.property_value(open_ - 1):
            return True
        return (b.text == "=" and any(self.is_(open_ - k, "type") for k in (3, 4, 5))) or (b.kind == IDENT and (self.is_(open_ - 2, "interface") or b.text == "as"))

    def method(self, i: int, t: Token, cls: str, iface: bool, exported: bool) -> None:
        k = self.after_angle(i + 1 + self.is_(i + 1, "?"))
        if t.text in ("constructor", "get", "set", "static", "async", "public", "private", "protected", "readonly", "override", "abstract", "new") or not self.is_(k, "(") or k not in self.match:
            return
        b = i - 1
        while self.is_(b, "async", "*", "public", "private", "protected", "static", "override", "readonly", "abstract", "get", "set"):
            if self.is_(b, "private", "protected", "get", "set", "abstract"):
                return
            b -= 1
        if not (self.is_(b, "{", ";", "}", ")") or self.t[b + 1].newline) or t.text.startswith("#"):
            return
        j, predicate = self.return_type(self.match[k] + 1)
        if self.is_(j, "{") and j in self.match:
            self.add_function(f"{cls}.{t.text}", i, k, self.params(k), (j, self.match[j] + 1), False, "MethodDeclaration", exported, class_name=cls, iface=iface, type_params=len(self.split_angle(i + 1, k)), predicate=predicate)

    def variable(self, i: int, named: set[str]) -> None:
        """Constants of literal value, and bindings whose fallback is an empty value."""
        j = i + 2
        if self.is_(j, ":"):
            j = self.skip_type(j + 1, {"=", ";", ","})
        if not self.is_(j, "="):
            return
        end = self.expression_end(j + 1, {";", ",", ")", "}"})
        name = self.t[i + 1]
        value = self.t[j + 1 : end]
        if self.is_(i, "const") and value and self.constant(value):
            self.out["constants"].append({"name": name.text, "line": name.line, "col": name.col, "value_text": re.sub(r"\s+", " ", self.text(j + 1, end)).strip(), "exported": self.exported(i)[0] or name.text in named, "seq": self.seq})
            self.seq += 1
        words = [x.text for x in value]
        empty = "null" if words[-2:] == ["??", "null"] else "undefined" if words[-2:] == ["??", "undefined"] else "[]" if words[-3:] == ["??", "[", "]"] else None
        p = self.parent[i]
        if empty and p >= 0 and self.is_(p, "{") or empty and p == -1:
            self.guards(i, name.text, empty)

    def guards(self, i: int, name: str, empty: str) -> None:
        """The binding at i and what the later statements of its block do with the name."""
        p = self.parent[i]
        stmts = self.statements_of(p) if p >= 0 else self.top_statements()
        at = next((k for k, (a, b) in enumerate(stmts) if a <= i < b), None)
        if at is None:
            return
        block = str(p)
        self.expr("CoalesceBinding", i, i + 2, attrs={"name": name, "block": block, "pos": str(at), "empty": empty})
        for pos in range(at + 1, len(stmts)):
            a, b = stmts[pos]
            words = [x.text for x in self.t[a:b]]
            if words[:1] == ["if"] and self.is_(a + 1, "("):
                test = [x.text for x in self.t[a + 2 : self.match.get(a + 1, a + 1)]]
                while test[:1] == ["("] and test[-1:] == [")"]:
                    test = test[1:-1]
                if self.same_partition(test, name, empty):
                    self.expr("GuardIf", a, a + 1, attrs={"name": name, "block": block, "pos": str(pos), "guard": empty})
            if any(self.t[k].text == name and self.is_(k + 1, "=", "??=", "||=", "&&=", "+=", "-=", "++", "--") and not self.is_(k - 1, ".") for k in range(a, b)):
                self.expr("Reassign", a, a + 1, attrs={"name": name, "block": block, "pos": str(pos)})

    @staticmethod
    def same_partition(test: list[str], name: str, empty: str) -> bool:
        """Whether a test splits the values of name as a test for the fallback `empty` would."""
        if empty == "[]":
            length = [name, ".", "length"]
            if test == ["!", *length]:
                return False
            flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
            if len(test) == 5 and test[2:] == length:
                test = [*length, flip.get(test[1], test[1]), test[0]]
            return len(test) == 5 and test[:3] == length and (test[3], test[4]) in {("===", "0"), ("==", "0"), ("!==", "0"), ("!=", "0"), (">", "0"), (">=", "1"), ("<", "1")}
        return test == ["!", name] or (len(test) == 3 and test[1] in ("===", "==", "!==", "!=") and {test[0], test[2]} == {name, empty})

    def top_statements(self) -> list[tuple[int, int]]:
        out, i = [], 0
        while i < len(self.t):
            j = self.statement_end(i, len(self.t))
            out.append((i, j))
            i = max(j, i + 1)
        return out

    def constant(self, value: list[Token]) -> bool:
        """Literals, signed literals, and operators between such."""
        want = True
        for t in value:
            if want:
                if t.kind in (STRING, NUMBER) or (t.kind == TEMPLATE and "${" not in t.text):
                    want = False
                elif not (t.kind == PUNCT and t.text in ("-", "+", "!", "~", "++", "--")):
                    return False
            elif t.kind == PUNCT and t.text in ("+", "-", "*", "/", "%", "**", "|", "&", "^", "<<", ">>", ">>>", "||", "&&", "??", "==", "===", "<", ">"):
                want = True
            else:
                return False
        return not want

    def as_(self, i: int) -> None:
        end = self.skip_type(i + 1, {";", ",", ")", "]", "}", "&&", "||", "??", "=", "==", "===", "!==", "!=", "+", "-", "?", ":", ">"})
        if self.is_(i + 1, "const"):
            end = i + 2
        target = self.t[i + 1]
        words = [x.text for x in self.t[i + 1 : end]]
        kind = target.text if len(words) == 1 and words[0] in ("any", "unknown", "never", "const") else "type"
        a = i - 1
        inner = None
        if self.is_(a, "unknown", "any", "never") and self.is_(a - 1, "as"):
            inner = self.t[a].text
        elif self.is_(a, ")") and a in self.match and self.is_(a - 1, "unknown") and self.is_(a - 2, "as"):
            inner = "unknown"
        while a > 0:  # the start of the operand: a chain of names, calls and members
            if a in self.match and self.match[a] < a:
                a = self.match[a]
                if a and (self.t[a - 1].kind == IDENT and self.t[a - 1].text not in _KEYWORDS or self.t[a - 1].text in (")", "]", "!")) and not self.t[a].newline:
                    a -= 1
                    continue
            if self.is_(a - 1, ".", "?."):
                a -= 2
            elif self.is_(a - 1, "as"):
                a -= 2
            elif self.is_(a - 1, "await", "new", "typeof", "!", "-"):
                a -= 1
            else:
                break
        literal = any(self.is_(k, "{") for k in range(i + 1, end)) and not any(self.is_(k, "|", "&", "=>") and self.parent[k] == self.parent[i] for k in range(i + 1, end))
        self.expr("AsExpression", max(a, 0), max(end, i + 2), operand=self.text(max(a, 0), i), flags={"is_const": kind == "const", "target_has_literal": literal}, attrs={"target_kind": kind} | ({"inner_target": inner} if inner else {}))

    def catch(self, i: int) -> None:
        j = i + 1
        name = None
        if self.is_(j, "(") and j in self.match:
            name = self.t[j + 1].text if self.t[j + 1].kind == IDENT else None
            j = self.match[j] + 1
        if not (self.is_(j, "{") and j in self.match):
            return
        me = f"Catch:{self.t[i].start}"
        self.expr("Catch", i, self.match[j] + 1)
        for k in self.handler_uses(j, name):
            self.expr("HandlerUse", k, k + 1, parent=me)
        k = j + 1
        while k < self.match[j]:
            after = self.past_function(k)
            if after > k:
                k = after
                continue
            if self.t[k].kind == IDENT and self.t[k].text == "throw":
                end = self.expression_end(k + 1, {";", "}"})
                words = [x.text for x in self.t[k + 1 : end]]
                is_new = words[:1] == ["new"]
                by_part = name is not None and any(self.t[x].text == name and self.is_(x + 1, ".", "?.") for x in range(k + 1, end))
                self.expr("ThrowNew", k, max(end, k + 1), parent=me, flags={"refs_error": "(" in words and self.refers(k + 1, end, name) and (is_new or by_part), "has_cause": "cause" in words})
            k += 1

    def promise_catch(self, i: int) -> None:
        """A .catch(handler) with one inline handler, reported where its receiver begins; the receiver is taken for a promise."""
        o = i + 1
        if not (self.is_(o, "(") and o in self.match):
            return
        parts = self.split(o)
        if len(parts) != 1:
            return
        a, b = parts[0]
        f = a + self.is_(a, "async")
        name, body = None, None
        if self.is_(f, "function"):
            p = f + 1
            while p < b and not self.is_(p, "("):
                p += 1
            name, body = (self.t[p + 1].text if self.t[p + 1].kind == IDENT else None), self.match.get(p, p) + 1
        elif self.t[f].kind == IDENT and self.is_(f + 1, "=>"):
            name, body = self.t[f].text, f + 2
        elif self.is_(f, "(") and f in self.match:
            k = self.match[f] + 1
            while k < b and not self.is_(k, "=>"):
                k += 1
            if k < b:
                name, body = (self.t[f + 1].text if self.t[f + 1].kind == IDENT else None), k + 1
        if body is None or body >= b:
            return
        start = self.chain_start(i - 1)
        me = f"Catch:{self.t[i].start}"
        self.expr("Catch", start, self.match[o] + 1, attrs={"form": "promise"})
        self.out["expr_facts"][-1]["node_id"] = me
        block = self.is_(body, "{") and body in self.match
        uses = self.handler_uses(body, name) if block else [body] if self.refers(body, b, name) else []
        for k in uses:
            self.expr("HandlerUse", k, k + 1, parent=me)

    def chain_start(self, dot: int) -> int:
        """The first token of the member and call chain that the dot continues."""
        k = dot
        while k > 0:
            k -= 1
            if k in self.match and self.match[k] < k:
                k = self.match[k]
                if k and (self.t[k - 1].kind == IDENT and self.t[k - 1].text not in _KEYWORDS or self.is_(k - 1, ")", "]")):
                    continue
                return k
            if self.is_(k - 1, ".", "?."):
                k -= 1
                continue
            return k
        return k

    def past_function(self, k: int) -> int:
        """The token after the function that begins at k, or k if none does."""
        body = None
        if self.is_(k, "function"):
            o = k
            while o < len(self.t) and not self.is_(o, "("):
                o += 1
            o = self.match.get(o, o) + 1
            while o < len(self.t) and not self.is_(o, "{"):
                o += 1
            return self.match.get(o, o) + 1
        if self.is_(k, "(") and k in self.match and self.is_(self.match[k] + 1, "=>"):
            body = self.match[k] + 2
        elif k + 1 < len(self.t) and self.t[k].kind == IDENT and self.is_(k + 1, "=>"):
            body = k + 2
        if body is None or body >= len(self.t):
            return k
        return self.match[body] + 1 if self.is_(body, "{") and body in self.match else self.expression_end(body, {",", ")", ";", "]", "}"})

    def refers(self, lo: int, hi: int, name: str | None) -> bool:
        """Whether tokens lo .. hi - 1 use the name as a value, functions in between left out."""
        if name is None:
            return False
        inside = re.compile(r"\$\{[^}]*(?<![\w$.])" + re.escape(name) + r"(?![\w$])")
        k = lo
        while k < hi:
            after = self.past_function(k)
            if after > k:
                k = after
                continue
            t = self.t[k]
            if t.kind == TEMPLATE and inside.search(t.text):
                return True
            is_key = self.is_(k + 1, ":") and self.is_(k - 1, "{", ",")
            if t.kind == IDENT and t.text == name and not self.is_(k - 1, ".", "?.", "const", "let", "var") and not is_key:
                return True
            k += 1
        return False

    def ends(self, a: int, b: int) -> bool:
        """Whether the statement in tokens a .. b - 1 never goes on to the next."""
        if self.is_(a, "return", "throw"):
            return True
        if self.is_(a, "{") and a in self.match:
            inner = self.statements_of(a)
            return bool(inner) and self.ends(*inner[-1])
        if self.is_(a, "if") and self.is_(a + 1, "(") and a + 1 in self.match:
            first = self.match[a + 1] + 1
            mid = self.statement_end(first, b)
            return self.is_(mid, "else") and self.ends(first, mid) and self.ends(mid + 1, b)
        return False

    def handler_uses(self, open_: int, name: str | None) -> list[int]:
        """Tokens in a handler's block that hand its error on: a throw, a return or a call that mentions it. Code after a return or throw doesn't count."""
        out = []
        for a, b in self.statements_of(open_):
            k = a
            while k < b:
                after = self.past_function(k)
                if after > k:
                    k = after
                    continue
                if self.is_(k, "{") and k in self.match and (k == a or self.is_(k - 1, ")", "else", "try", "finally", "do")):
                    out += self.handler_uses(k, name)
                    k = self.match[k] + 1
                    continue
                t = self.t[k]
                if t.kind == IDENT and t.text == "throw":
                    out.append(k)
                elif t.kind == IDENT and t.text == "return":
                    if self.refers(k + 1, self.expression_end(k + 1, {";", "}"}), name):
                        out.append(k)
                elif self.is_(k, "(") and k in self.match and k and (self.t[k - 1].kind == IDENT and (self.t[k - 1].text not in _NO_CALL or self.t[k - 1].text == "super" or self.is_(k - 2, ".", "?.")) or self.is_(k - 1, ")", "]", "?.")) and not self.new_before(k - 1):
                    if self.refers(k + 1, self.match[k], name):
                        out.append(k)
                k += 1
            if self.ends(a, b):
                break
        return out

    def call(self, i: int) -> None:
        j = i - 1
        has_types = False
        if self.is_(j, ">"):
            k = j
            while k > 0 and not self.is_(k, "<", ";", "{", "("):
                k -= 1
            if self.is_(k, "<") and self.after_angle(k) == i:
                has_types, j = True, k - 1
        if self.is_(j, "?."):
            j -= 1
        if j < 0 or self.t[j].kind != IDENT or self.t[j].text in _NO_CALL and not self.is_(j - 1, ".", "?.") or i not in self.match:
            return
        if self.is_(j - 1, "function", "new", "*", "get", "set", "interface", "class") or self.is_(j - 1, ".") and self.new_before(j):
            return
        after = self.match[i] + 1
        if self.is_(after, "{") and not self.is_(after - 1, ";") and (self.is_(j - 1, "{", "}", ";", "async", "public", "private", "protected", "static", "override") or self.t[j].newline) and self.parent[j] >= 0 and self.class_like(self.parent[j]):
            return
        if self.is_(after, ":") and self.class_like(self.parent[j]) or self.is_(after, "=>"):
            return
        t = self.t[j]
        parts = self.split(i)
        self.out["call_sites"].append({"call_id": str(t.start), "line": t.line, "callee_name": t.text, "arg_count": len(parts), "has_spread": any(self.is_(a, "...") for a, _ in parts), "has_type_args": has_types, "args": [{"kind": self.arg_kind(a, b), "text": self.text(a, b)} for a, b in parts]})

    def new_before(self, j: int) -> bool:
        while self.is_(j - 1, ".") and j - 2 >= 0 and self.t[j - 2].kind == IDENT:
            j -= 2
        return self.is_(j - 1, "new")

    def class_like(self, open_: int) -> bool:
        """Whether a brace opens a class, an interface or an object type."""
        k = open_ - 1
        while k >= 0 and open_ - k < 40 and not self.is_(k, ";", "{", "}", ")"):
            if self.is_(k, "class", "interface"):
                return True
            k -= 1
        return open_ >= 0 and self.type_brace(open_)

    def arg_kind(self, a: int, b: int) -> str:
        t = self.t[a]
        if b - a == 1:
            if t.kind == TEMPLATE:
                return "other" if "${" in t.text else "template"
            if t.kind in (STRING, NUMBER):
                return t.kind
            if t.text in ("true", "false", "null", "undefined"):
                return t.text
        if b - a == 2 and t.text == "-" and self.t[a + 1].kind == NUMBER:
            return "negative"
        return "spread" if t.text == "..." else "other"

    def is_block(self, i: int) -> bool:
        if i not in self.match or self.class_like(i):
            return False
        if i in self.bodies or i == 0 or self.is_(i - 1, ";", "{", "}", "else", "try", "finally", "do", "=>"):
            return not self.object_like(i) or i in self.bodies
        if self.is_(i - 1, "catch"):
            return True
        if self.is_(i - 1, ")") and i - 1 in self.match:
            return not self.is_(self.match[i - 1] - 1, "switch")
        return self.after_return_type(i)

    def object_like(self, i: int) -> bool:
        return self.is_(i - 1, "{") and not self.is_block(i - 1) if self.is_(i - 1, "{") else False

    def after_return_type(self, i: int) -> bool:
        k = i - 1
        while k > 0 and i - k < 60 and not self.is_(k, ";", "{", "}", "=", "=>"):
            if self.is_(k, ":") and self.is_(k - 1, ")"):
                return True
            k = self.match[k] - 1 if k in self.match and self.match[k] < k else k - 1
        return False

    def brace(self, i: int) -> None:
        if not self.is_block(i):
            return
        stmts = self.statements_of(i)
        if len(stmts) < 2:
            return
        rows = []
        for a, b in stmts:
            text = token_text(self.text(a, b))
            if text:
                rows.append({"block_id": str(self.t[i].start), "pos": len(rows), "tokens": text, "line": self.t[a].line, "col": self.t[a].col, "end_line": self.t[b - 1].line})
        self.out["statements"] += rows

    def scope_of(self, i: int) -> tuple[int, int] | None:
        best = None
        for a, b in self.scopes:
            if a <= i < b and (best is None or b - a < best[1] - best[0]):
                best = (a, b)
        return best

    def literals(self) -> None:
        """String values of properties, by function, and the shapes that functions return."""
        for i, t in enumerate(self.t):
            if t.kind == STRING and self.is_(i - 1, ":") and i - 2 >= 0 and self.parent[i] >= 0 and self.is_(self.parent[i], "{") and self.is_(i - 3, "{", ",") and not self.type_brace(self.parent[i]) and not self.class_like(self.parent[i]):
                const = self.is_(i + 1, "as") and self.is_(i + 2, "const")
                if self.is_(i + 1, ",", "}") or const:
                    s = self.scope_of(i)
                    if s is not None:
                        self.out["literal_props"].append({"line": t.line, "key": self.t[i - 2].text.strip("\"'"), "value": t.text[1:-1], "is_as_const": const, "scope_id": self.t[s[0]].start})
            elif t.kind == IDENT and t.text == "return" and self.is_(i + 1, "{") and i + 1 in self.match:
                s = self.scope_of(i)
                if s is not None and s[0] in self.bodies:
                    f = self.out["functions"][self.bodies[s[0]]]
                    self.shape(i + 1, None, f["name"], f["line"])

    def shape(self, open_: int, at: Token | None, name: str, line: int | None = None) -> None:
        names = []
        for a, b in self.split(open_):
            if self.is_(a, "...", "[") or self.t[a].kind not in (IDENT, STRING, NUMBER):
                return
            names.append(self.t[a].text.strip("\"'"))
        if names:
            self.out["return_shapes"].append({"fn_line": line if line is not None else at.line, "fn_name": name, "props": names})

    def import_(self, i: int) -> None:
        j = i + 1 + (self.is_(i + 1, "type") and not self.is_(i + 2, "from", ","))
        end = next((k for k in range(j, min(len(self.t), j + 4000)) if self.t[k].kind == STRING), None)
        if end is None or end == i + 1:
            return
        source = self.t[end].text[1:-1]
        row = lambda local, name: self.out["imports"].append({"local_name": local, "imported_name": name, "source": source})
        if self.t[j].kind == IDENT and not self.is_(j, "from"):
            row(self.t[j].text, "default")
            j += 1 + self.is_(j + 1, ",")
        if self.is_(j, "*") and self.is_(j + 1, "as"):
            row(self.t[j + 2].text, "*")
        elif self.is_(j, "{") and j in self.match:
            for a, b in self.split(j):
                a += self.is_(a, "type") and b - a > 1 and not self.is_(a + 1, "as")
                row(self.t[b - 1].text, self.t[a].text)

    def export(self, i: int) -> None:
        j = i + 1 + self.is_(i + 1, "type")
        row = lambda local, name, at: self.out["imports"].append({"local_name": local, "imported_name": name, "source": self.t[at].text[1:-1]})
        if self.is_(j, "*") and self.is_(j + 1, "from") and j + 2 < len(self.t):
            row("*", "*", j + 2)
        elif self.is_(j, "{") and j in self.match and self.is_(self.match[j] + 1, "from"):
            for a, b in self.split(j):
                a += self.is_(a, "type") and b - a > 1 and not self.is_(a + 1, "as")
                row(self.t[b - 1].text, self.t[a].text, self.match[j] + 2)


def extract(source: str) -> dict[str, list[dict[str, Any]]]:
    """Fact rows of one file by table; an empty text has none."""
    return Facts(source or "").run()
