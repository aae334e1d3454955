"""A lexer for TypeScript text.

Two modes. parsing=True reads regular expressions and template literals as a
parser would, one token each. parsing=False scans without a parser's help, as
needed for hash parity: a slash is an operator and a template ends where its
first substitution begins, the rest being ordinary code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

IDENT, NUMBER, STRING, TEMPLATE, REGEX, PUNCT = "ident", "number", "string", "template", "regex", "punct"

_SPACE = re.compile(r"[\s\ufeff]+")
_IDENT = re.compile(r"[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_NO_REGEX_AFTER = {"this", "super", "null", "true", "false"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    col: int
    newline: bool  # whether a line break stands before it


@dataclass(slots=True)
class Comment:
    kind: str
    value: str
    start: int
    end: int
    start_line: int
    end_line: int


def _template_end(src: str, at: int) -> int:
    """The end of a template literal that begins at `at`, nested substitutions included."""
    i, n = at + 1, len(src)
    while i < n:
        c = src[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and src[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                if src[i] == "`":
                    i = _template_end(src, i)
                    continue
                if src[i] in "\"'":
                    i = _string_end(src, i)
                    continue
                depth += (src[i] == "{") - (src[i] == "}")
                i += 1
        else:
            i += 1
    return n


def _string_end(src: str, at: int) -> int:
    q, i, n = src[at], at + 1, len(src)
    while i < n and src[i] != q and src[i] != "\n":
        i += 2 if src[i] == "\\" else 1
    return min(n, i + 1) if i < n and src[i] == q else i


def _regex_end(src: str, at: int) -> int:
    i, n, in_class = at + 1, len(src), False
    while i < n and src[i] != "\n":
        c = src[i]
        if c == "\\":
            i += 1
        elif c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "/" and not in_class:
            i += 1
            while i < n and src[i].isalpha():
                i += 1
            return i
        i += 1
    return -1


def tokenize(src: str, parsing: bool = True) -> tuple[list[Token], list[Comment]]:
    tokens: list[Token] = []
    comments: list[Comment] = []
    i, n, line, line_start, newline = 0, len(src), 1, 0, False
    if src.startswith("#!"):
        i = src.find("\n") if "\n" in src else n

    def advance(to: int) -> None:
        nonlocal line, line_start
        count = src.count("\n", i, to)
        if count:
            line += count
            line_start = src.rfind("\n", i, to) + 1

    while i < n:
        m = _SPACE.match(src, i)
        if m:
            newline |= "\n" in m[0]
            advance(m.end())
            i = m.end()
            continue
        two = src[i : i + 2]
        if two == "//":
            end = src.find("\n", i)
            end = n if end < 0 else end
            comments.append(Comment("Line", src[i + 2 : end], i, end, line, line))
            i = end
            continue
        if two == "/*":
            end = src.find("*/", i + 2)
            end = n if end < 0 else end + 2
            first = line
            newline |= "\n" in src[i:end]
            start = i
            advance(end)
            comments.append(Comment("Block", src[start + 2 : end - 2], start, end, first, line))
            i = end
            continue
        c = src[i]
        kind, end = PUNCT, i + 1
        if c in "\"'":
            kind, end = STRING, _string_end(src, i)
        elif c == "`":
            kind = TEMPLATE
            if parsing:
                end = _template_end(src, i)
            else:
                end = i + 1
                while end < n and src[end] != "`" and src[end : end + 2] != "${":
                    end += 2 if src[end] == "\\" else 1
                end = min(n, end + (2 if src[end : end + 2] == "${" else 1))
        elif (m := _IDENT.match(src, i)) and not (c in "#@" and len(m[0]) == 1) and c != "@":
            kind, end = IDENT, m.end()
        elif (c.isdigit() or (c == "." and src[i + 1 : i + 2].isdigit())) and (m := _NUMBER.match(src, i)):
            kind, end = NUMBER, m.end()
        elif c == "/" and parsing and _regex_allowed(tokens) and (stop := _regex_end(src, i)) > 0:
            kind, end = REGEX, stop
        elif m := _PUNCT.match(src, i):
            end = m.end()
        tokens.append(Token(kind, src[i:end], i, end, line, i - line_start + 1, newline))
        newline = False
        advance(end)
        i = end
    return tokens, comments


def _regex_allowed(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    t = tokens[-1]
    if t.kind == IDENT:
        return t.text in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof") and t.text not in _NO_REGEX_AFTER
    if t.kind in (NUMBER, STRING, TEMPLATE, REGEX):
        return False
    return t.text not in (")", "]", "}", "++", "--")


def token_text(src: str) -> str:
    """The scanner's tokens joined by one space, comments and white space gone."""
    return " ".join(t.text for t in tokenize(src, parsing=False)[0]).strip()
