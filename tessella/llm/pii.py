"""Personal data found by a linear-chain conditional random field.

Tokens are runs of letters, digits and the signs @ . - + _ / less their outer
signs, and colons and brackets by themselves; white space and all other signs
only separate. Features are shapes of a token and its neighbours (letters read
as a, digits as 9), what lies between them, and the digits, groups and colons
of the run that a token is in, so a small labelled table is enough to train on
and nothing hangs on vocabulary. Decoding is exact Viterbi in numpy batches.
Tokens at which no label can beat O whatever its neighbours are labelled cut the
chain into short segments; for plain words among plain words that is proved once
for the model, so only the surroundings of digits and signs are ever scored.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "IBAN", "SSN")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
RESULT = "doc_id bigint, kind string, start bigint, length int, shape string"
FEATURE_BITS = 16

#: Classes of bytes: 0 separates, 1 is part of a token, 2 to 4 are colons and brackets.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"@.-+_/")] = 1
#: Shape codes: letters (any case, any non-ASCII byte) are a, digits 9, other signs themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
for _lo, _hi in ((65, 90), (97, 122), (128, 255)):
    _SHAPE[_lo : _hi + 1] = ord("a")
    _CLASS[_lo : _hi + 1] = 1
_SHAPE[48:58] = ord("9")
_CLASS[48:58] = 1
for _k, _c in enumerate(b":()"):
    _CLASS[_c] = 2 + _k
#: Signs that are no part of a token at either end of it.
_OUTER = np.zeros(256, bool)
_OUTER[list(b".-_/")] = True
_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[list(b"0123456789abcdefABCDEF")] = True
_A, _NINE, _AT = ord("a"), ord("9"), ord("@")

#: Stand-ins for the shapes of a plain word, of a token of signs only and of the end of the text.
PLAIN, EMPTY, EDGE = (np.uint64(x) for x in (1, 2, 3))
#: What lies between two tokens: nothing, one blank, = or , or something else; or there is no other token.
ADJACENT, BLANK, EQUALS, COMMA, APART, END = range(6)


# --- the labelled table ---------------------------------------------------

#: Public formats: d is a digit, h a hexadecimal digit, w a word, l a letter, A a capital, X a capital or a digit, n a number up to 255, t a top-level domain; a number repeats.
FORMATS = {
    "EMAIL": "{w}@{w}.{t}|{w}@{w}.{w}.{t}|{w}.{w}@{w}.{t}|{w}{d}@{w}.{t}|{w}{d3}@{w}-{w}.{t}|{w}_{w}@{w}.{t}|{l}_{w}@{w}.{t}|{w}_{w}{d2}@{w}.{t}|{l}{d4}@{w}.{t}|{w}.{d2}@{w}.{t}|{w}-{w}@{w}{d}.{t}|{w}+{w}@{w}.{t}|{l}.{w}@{w}.{t}|{w}.{w}.{w}@{w}.{t}|{d2}{w}@{w}.{t}|{w}.{w}{d}@{w}.{w}.{t}|{w}+{d3}@{w}.{t}|{w}@{w}{d}.{w}.{t}|{w}.{w}@{w}-{w}.{t}|{w}@{w}-{w}.{w}.{t}|{l}{w}@{w}-{w}.{t}",
    "PHONE": "({d3}) {d3}-{d4}|({d3}){d3}-{d4}|{d3}-{d3}-{d4}|{d3}.{d3}.{d4}|{d3} {d3} {d4}|{d3} {d3}-{d4}|+1 {d3} {d3} {d4}|+1-{d3}-{d3}-{d4}|+1 ({d3}) {d3}-{d4}|+1 {d3}-{d3}-{d4}|1-{d3}-{d3}-{d4}|+{d11}|+{d12}|0{d2} {d4} {d4}|0{d4} {d6}|+44 {d2} {d4} {d4}|+44 {d4} {d6}|07{d3} {d6}|0{d3} {d7}|+49 {d3} {d7}|0{d3}/{d7}|+49 (0){d3} {d6}|0{d} {d2} {d2} {d2} {d2}|+33 {d} {d2} {d2} {d2} {d2}|0{d}.{d2}.{d2}.{d2}.{d2}|+34 {d3} {d3} {d3}|6{d2} {d3} {d3}|9{d2} {d2} {d2} {d2}|+{d2} {d} {d4} {d4}|+{d2} {d2} {d3} {d4}|+{d2}-{d2}-{d4}-{d4}|+{d2} {d3} {d7}|({d2}) {d4}-{d4}|0{d2}-{d4}-{d4}",
    "IP": "{n}.{n}.{n}.{n}|{n}.{n}.{n}.{n}|{n}.{n}.{n}.{n}|{n}.{n}.{n}.{n}/{d2}|{h4}:{h4}:{h4}:{h4}:{h4}:{h4}:{h4}:{h4}|{h4}:{h3}:{h}:{h}:{h}:{h}:{h2}:{h}|{h4}:{h3}::{h}|{h4}::{h4}:{h4}:{h4}:{h4}|{h4}:{h4}:{h}::{h4}|{h4}::{h}|{h4}:{h3}:{h2}::{h}:{h4}|{h4}:{h4}::{h2}",
    "CARD": "{d16}|{d4} {d4} {d4} {d4}|{d4}-{d4}-{d4}-{d4}|{d4} {d6} {d5}|{d15}|{d4}-{d6}-{d5}",
    "IBAN": "DE{d20}|AT{d18}|BE{d14}|ES{d22}|PL{d26}|CH{d19}|PT{d23}|DK{d16}|GB{d2}{A4}{d14}|NL{d2}{A4}{d10}|IE{d2}{A4}{d14}|FR{d12}{X11}{d2}|IT{d2}{A}{d22}|DE{d2} {d4} {d4} {d4} {d4} {d2}|GB{d2} {A4} {d4} {d4} {d4} {d2}|ES{d2} {d4} {d4} {d4} {d4} {d4}|NL{d2} {A4} {d4} {d4} {d2}|BE{d2} {d4} {d4} {d4}|AT{d2} {d4} {d4} {d4} {d4}",
    "SSN": "{d3}-{d2}-{d4}",
}
#: Look-alikes that are nobody's data.
OTHERS = "{d}|{d2}|{d3}|{d4}|{d5}|{d6}|{d7}|{d8}|{d9}|{d10}|{d12}|{d20}|{d}.{d}|{d2}.{d2}|{d}.{d}.{d}|{d}.{d2}.{d}-{w}|v{d}.{d}.{d2}|{d}.|{d2}:{d2}|{d2}:{d2}:{d2}|{d}:{d}|20{d2}-{d2}-{d2}|{d2}/{d2}/20{d2}|{d2}.{d2}.20{d2}|20{d2}-{d2}-{d2}T{d2}:{d2}:{d2}|19{d2}-20{d2}|19{d2} 20{d2}|20{d2} 20{d2} 20{d2}|20{d2}|${d3}.{d2}|{d2}%|{d},{d3},{d3}|{d},{d3}|{d2} {d3}|{d} {d} {d}|{d2} {d2}|{d2} {d2} {d2}|{d3} {d3}|{h16}|{h32}|{h40}|{h8}-{h4}-{h4}-{h4}-{h12}|{h2}:{h2}:{h2}:{h2}:{h2}:{h2}|AKIA{X16}|{w}={h18}|{w} = \"{h40}\"|@{w}|@{w}{d2}|{w}@{w}|{w}@|{w}.{t}|{w}.{w}.{t}|https://{w}.{t}/{w}/{d3}|http://{w}.{w}.{t}/{w}-{w}|www.{w}.{t}|{w}/{w}/{w}.{w}|{w}{d2}|{w}{d}|{w}-{d2}|{w}_{d3}|{w}_{w}|{w}-{w}|{w}.{w}|{w}::{w}|{w}::{w}::{w}|{w}:{w}|{w}: {w}|({w})|({d})|({d2})|({d4})|({w} {w})|{w}({w})|{w}({d})|{w}'{w}|+|--|-|:|{d3}-{d3}|{d3}-{d4}|{d5}-{d4}|{d2}-{d2}|978-{d}-{d2}-{d6}-{d}|{A2}-{d4}|{A3}{d6}|#{d4}|{d4}x{d4}|{d2}.{d6}, {d}.{d6}|+{d}|+{d2}%|-{d2}|{d}e-{d}|{d}/{d}|{w}[{d}]|{d}) {w}|{d2}:{d2}-{d2}:{d2}|{d2}({d})|{w}+{w}|{w}/{w}|{d3}-{d4}-{d5}|{A}{d2}{w}{d3}".split("|")
#: What may stand around a datum: (before, after).
AROUND = [("", "")] * 8 + [("(", ")"), ("<", ">"), ('"', '"'), ("'", "'"), ("[", "]"), ("", "."), ("", ","), ("", ";"), ("", "!!"), ("", "***"), ("", ":"), ("", "?"), ("", ")"), ("(", ""), ("{w}:", ""), ("{w}: ", ""), ("{w}:", ""), ("{w}=", ""), ("{w}='", "'"), ("{w} (", ")"), ("**", "**"), ("", ",{w}"), ("_", "_")]


def labelled_table(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): short texts with personal data in FORMATS and look-alikes that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ" if rng.random() < 0.2 else "etaoinshrdlucmfbcde") for _ in range(rng.randint(1, 11)))
    make = {
        "d": lambda: rng.choice("0123456789"), "h": lambda: rng.choice("0123456789abcdef"), "l": lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"), "A": lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "X": lambda: rng.choice("ABCDEFGHJKLMN0123456789"),
        "n": lambda: str(rng.randint(0, 255)), "w": word, "t": lambda: rng.choice(["com", "org", "net", "io", "de", "co.uk", "fr", "info", "edu"]),
    }

    def fill(pattern: str) -> str:
        return re.sub(r"\{(\w)(\d*)\}", lambda m: "".join(make[m[1]]() for _ in range(int(m[2] or 1))), pattern)

    formats = {k: v.split("|") for k, v in FORMATS.items()}
    kinds = [*KINDS, "EMAIL", "PHONE", "PHONE", "IP"]
    table = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(4, 12)):
            r = rng.random()
            if r < 0.3:
                kind = rng.choice(kinds)
                piece = fill(rng.choice(formats[kind]))
                piece = piece.upper() if rng.random() < 0.08 else piece
                before, after = (fill(x) for x in rng.choice(AROUND))
                if kind == "IP" and "/" not in piece and rng.random() < 0.15:
                    after = fill(rng.choice([":{d4}", ":{d2}"])) if "." in piece else ""
                spans.append((len(text) + len(before), len(text) + len(before) + len(piece), kind))
                text += before + piece + after
                if rng.random() < 0.1:  # two in a row
                    text += rng.choice([",", ";", "|", " ", " "])
                    piece = fill(rng.choice(formats[kind]))
                    spans.append((len(text), len(text) + len(piece), kind))
                    text += piece
            elif r < 0.6:
                piece = fill(rng.choice(OTHERS))
                text += (piece.upper() if rng.random() < 0.05 else piece) + rng.choice(["", "", "", ".", ",", ";", ")", ":"])
            else:
                piece = word()
                text += (piece.capitalize() if rng.random() < 0.3 else piece) + rng.choice(["", "", "", "", ".", ",", ":", "?", "!"])
            text += rng.choice([" ", " ", " ", " ", "\n", " | "])
        table.append((text, spans))
    return table


# --- features -------------------------------------------------------------


@dataclass
class Tokens:
    """Cores of the tokens of a batch of texts: byte spans, the row of each, shapes, and what lies before each."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    shape: np.ndarray
    exact: np.ndarray
    domain: np.ndarray
    address: np.ndarray
    digits: np.ndarray
    signs: np.ndarray
    gap: np.ndarray
    run: np.ndarray
    colons: np.ndarray


def tokenise(buf: np.ndarray, off: np.ndarray) -> Tokens:
    classes = _CLASS[buf]
    starts, ends, rows = tv.tokens(buf, classes, off)
    n = len(starts)
    if n == 0:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Tokens(z, z, z, u, u, u, u, z, u, z, u, u)
    # The core lies between the first and the last byte that isn't an outer sign.
    core = (classes > 0) & ~_OUTER[buf]
    place = np.arange(len(buf) + 1)
    following = np.concatenate([np.where(core, place[:-1], len(buf)), [len(buf)]])
    following = np.minimum.accumulate(following[::-1])[::-1]
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(core, place[:-1], -1))])
    first, stop = np.minimum(following[starts], ends), np.maximum(last[ends] + 1, starts)
    empty = first >= stop
    first, stop = np.where(empty, starts, first), np.where(empty, starts, stop)
    code = _SHAPE[buf]
    other = np.concatenate([[0], np.cumsum(code != _A, dtype=np.int64)])
    plain = ~empty & (other[stop] == other[first])
    shape, exact, domain, address = np.full(n, PLAIN), np.full(n, PLAIN), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    shape[empty] = exact[empty] = EMPTY
    digits, signs = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    odd = np.flatnonzero(~plain & ~empty)
    letters = np.zeros(n, np.int64)
    if len(odd):
        f, s = first[odd], stop[odd]
        size = s - f
        at = np.cumsum(size) - size
        text = code[np.repeat(f - at, size) + np.arange(size.sum())]
        head = np.zeros(len(text), bool)
        head[at] = True
        repeat = np.zeros(len(text), bool)
        repeat[1:] = (text[1:] == text[:-1]) & ~head[1:]
        at_sign = np.maximum.accumulate(np.where(text == _AT, np.arange(len(text)), -1))[at + size - 1]
        has_at = at_sign >= at
        for keep, out in ((~repeat, shape), (~(repeat & (text == _A)), exact)):
            new, kept = np.concatenate([[0], np.cumsum(keep)]), text[keep]
            out[odd] = tv.span_hashes(kept, new[at], new[at + size]) | np.uint64(4)
            if out is shape:  # the part after the last @, and whether something stands before it
                after = tv.span_hashes(kept, new[np.where(has_at, at_sign, at)], new[at + size]) ^ (at_sign > at).astype(np.uint64)
                domain[odd] = np.where(has_at, after | np.uint64(4), np.uint64(0))
        at_signs, dots = (np.concatenate([[0], np.cumsum(text == x)]) for x in (_AT, ord(".")))
        after_dots = np.where(has_at, dots[at + size] - dots[np.maximum(at_sign, at)], 0)
        address[odd] = (np.minimum(at_signs[at + size] - at_signs[at], 2) * 8 + np.minimum(after_dots, 2) * 2 + (at_sign > at)).astype(np.uint64)
        nine, small = np.concatenate([[0], np.cumsum(text == _NINE)]), np.concatenate([[0], np.cumsum((text == _A) | (text == _AT))])
        digits[odd] = np.minimum(nine[at + size] - nine[at], 40)
        letters[odd] = small[at + size] - small[at]
        flags = np.zeros(len(odd), np.uint64)
        for k, sign in enumerate(b"@+().-:/_"):
            c = np.concatenate([[0], np.cumsum(text == sign)])
            count = c[at + size] - c[at]
            flags |= np.minimum(count, 3).astype(np.uint64) << np.uint64(2 * k)
        signs[odd] = flags
    gap = np.full(n, END)
    same = rows[1:] == rows[:-1]
    between, byte = first[1:] - stop[:-1], buf[np.minimum(stop[:-1], len(buf) - 1)]
    gap[1:] = np.where(same, np.select([between == 0, (between == 1) & (byte == 32), (between == 1) & (byte == 61), (between == 1) & (byte == 44)], [ADJACENT, BLANK, EQUALS, COMMA], APART), END)
    # Runs of numbers and brackets with nothing or a blank between: their digits and groups.
    bracket = (classes[starts] > 2) & ~empty
    number = ((digits > 0) & (letters == 0)) | bracket
    joined = np.zeros(n, bool)
    joined[1:] = number[1:] & number[:-1] & (gap[1:] <= BLANK)
    group = np.cumsum(~joined) - 1
    total, groups = np.bincount(group, digits), np.bincount(group, digits > 0)
    begin = np.flatnonzero(~joined)
    run = np.where(number, np.minimum(total[group], 40) * 64 + np.minimum(groups[group], 7) * 8 + np.minimum(np.arange(n) - begin[group], 3), 0).astype(np.uint64)
    # Tokens with nothing between them: the colons of the chain, where all else in it is hexadecimal.
    chain = np.cumsum(gap != ADJACENT) - 1
    colon = classes[starts] == 2
    foreign = np.concatenate([[0], np.cumsum(~_HEXADECIMAL[buf], dtype=np.int64)])
    hexadecimal = (foreign[stop] == foreign[first]) & (stop - first <= 4) & ~empty
    n_colons, pure = np.bincount(chain, np.where(colon, stop - first, 0)), np.bincount(chain, ~(hexadecimal | colon))
    colons = (np.minimum(n_colons[chain], 8) * 4 + np.minimum(pure[chain], 1) * 2 + hexadecimal).astype(np.uint64)
    colons[n_colons[chain] == 0] = 0
    return Tokens(first, stop, rows, shape, exact, domain, address, digits, signs, gap, run, colons)


def features(t: Tokens, where: np.ndarray) -> np.ndarray:
    """Hashed features of the tokens at where: (n, number of feature kinds)."""
    n = len(t.rows)

    def near(step: int, values: np.ndarray) -> np.ndarray:
        at = np.clip(where + step, 0, n - 1)
        return np.where((where + step != at) | (t.rows[at] != t.rows[where]), EDGE, values[at])

    ps, ns, pe, ne, pp, nn = near(-1, t.shape), near(1, t.shape), near(-1, t.exact), near(1, t.exact), near(-2, t.exact), near(2, t.exact)
    s, e, u = t.shape[where], t.exact[where], lambda x: x.astype(np.uint64)
    g = u(t.gap[where])
    after = np.minimum(where + 1, n - 1)
    h = np.where((where == n - 1) | (t.rows[after] != t.rows[where]), np.uint64(END), u(t.gap[after]))
    two = lambda a, b: a * np.uint64(0x9E3779B97F4A7C15) + tv.mix(b)
    run, digits, signs = t.run[where], u(t.digits[where]), t.signs[where]
    kinds = [
        np.zeros(len(where), np.uint64), s, e, ps, ns, two(ps, two(g, s)), two(ns, two(h, s)), two(pe, two(g, e)), two(ne, two(h, e)), two(pe, two(e, ne)), two(e, two(ne, nn)), two(e, two(pe, pp)),
        digits, signs, t.domain[where], t.address[where], two(t.address[where], two(g, h)), run, two(run, e), two(run >> np.uint64(3), g), t.colons[where], two(t.colons[where], s), two(t.colons[where], g), two(digits, signs), two(g, h), two(two(g, s), run), two(two(h, s), run),
    ]
    return np.stack([(tv.mix(k + np.uint64((i + 1) * 0x51ED270B)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) for i, k in enumerate(kinds)], axis=1)


# --- model ----------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    end: np.ndarray
    margin: float
    plain_is_outside: bool


def finish(weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> Model:
    """The model with its cut rule.

    margin is the most that a label other than O can gain over O from the
    transitions on both its sides: a token whose score for O leads by more is O on
    the best path.
    """
    before, after = np.vstack([transitions, start]), np.vstack([transitions.T, end])
    margin = max(float((before[:, y] - before[:, 0]).max() + (after[:, y] - after[:, 0]).max()) for y in range(1, len(LABELS)))
    # A plain word whose neighbours as far as two tokens away are plain words or ends of the text, with blanks or more between.
    plain = True
    for before, behind in itertools.product(range(3), repeat=2):
        k = np.full(before + 1 + behind, PLAIN)
        z, u = np.zeros(len(k), np.int64), np.zeros(len(k), np.uint64)
        for g, h in itertools.product((BLANK, APART), repeat=2):
            gap = np.full(len(k), h)
            gap[: before + 1] = g
            gap[0] = END
            score = weights[features(Tokens(z, z, z, k, k, u, u, z, u, gap, u, u), np.array([before]))].sum(axis=1)[0]
            plain &= bool(score[0] - score[1:].max() > margin)
    return Model(weights, transitions, start, end, margin, plain)


def _gold(text: str, spans: list[tuple[int, int, str]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    to_byte = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    gold = np.zeros(len(starts), np.int64)
    for a, b, kind in spans:
        inside = np.flatnonzero((starts >= to_byte[a]) & (ends <= to_byte[b]) & (ends > starts))
        gold[inside] = LABELS.index(f"I-{kind}")
        gold[inside[:1]] = LABELS.index(f"B-{kind}")
    return gold


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, rounds: int = 40, rate: float = 0.2, decay: float = 1e-4, dropout: float = 0.3, seed: int = 0) -> Model:
    """Maximum likelihood by Adam over the whole table: scaled forward-backward in numpy, all texts at once. It takes a second or two."""
    table = table or labelled_table()
    texts = tv.as_array(pa.array([x for x, _ in table]))
    buf, off = tv.buffers(texts)
    t = tokenise(buf, off)
    feats = features(t, np.arange(len(t.rows)))
    n_labels, n_rows = len(LABELS), len(table)
    bounds = np.searchsorted(t.rows, np.arange(n_rows + 1))
    gold = np.concatenate([_gold(text, spans, t.starts[a:b] - off[i], t.ends[a:b] - off[i]) for i, ((text, spans), a, b) in enumerate(zip(table, bounds[:-1], bounds[1:], strict=True))])
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")  # the longest first: at each place the open texts are a prefix
    size, begin = size[order], bounds[:-1][order]
    open_at = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]) + 1)]  # texts of more than k tokens
    # Features that occur once teach nothing that holds elsewhere: they share one weight, which stays 0.
    used, local, often = np.unique(feats, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(often > 1)
    rank = np.full(len(used), len(kept))
    rank[kept] = np.arange(len(kept))
    used, local = used[kept], rank[local.reshape(feats.shape)]
    by = np.argsort(local.ravel(), kind="stable")
    by = by[: int(np.searchsorted(local.ravel()[by], len(kept)))]
    owner, heads = by // local.shape[1], np.searchsorted(local.ravel()[by], np.arange(len(kept)))
    w, tr, st, en = (np.zeros(x, np.float32) for x in ((len(kept) + 1, n_labels), (n_labels, n_labels), n_labels, n_labels))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, tr, st, en)]
    onehot = np.eye(n_labels, dtype=np.float32)[gold]
    inner = np.flatnonzero(t.rows[1:] == t.rows[:-1])
    counts = np.zeros((n_labels, n_labels), np.float32)
    np.add.at(counts, (gold[inner], gold[inner + 1]), 1)
    firsts, lasts = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    rng = np.random.default_rng(seed)
    for step in range(1, rounds + 1):
        # Each round every token misses some kinds of features, so that none carries a decision alone.
        there = (rng.random(local.shape, np.float32) >= dropout).astype(np.float32) / np.float32(1 - dropout)
        emit = np.zeros((len(gold), n_labels), np.float32)
        for c in range(local.shape[1]):
            emit += w[local[:, c]] * there[:, c, None]
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        move, alpha, beta, scale = np.exp(tr), np.zeros_like(emit), np.zeros_like(emit), np.ones(len(gold), np.float32)
        for k in range(len(open_at) - 1):
            i = begin[: open_at[k]] + k
            a = emit[i] * (np.exp(st) if k == 0 else alpha[i - 1] @ move)
            scale[i] = a.sum(axis=1)
            alpha[i] = a / scale[i, None]
        for k in range(len(open_at) - 2, -1, -1):
            i, more = begin[: open_at[k]] + k, open_at[k + 1]
            b = np.tile(np.exp(en), (len(i), 1))
            b[:more] = (beta[i[:more] + 1] * emit[i[:more] + 1]) @ move.T
            beta[i] = b / b.sum(axis=1, keepdims=True)
        post = alpha * beta
        diff = post / post.sum(axis=1, keepdims=True) - onehot
        gw = np.zeros_like(w)
        gw[:-1] = np.add.reduceat(diff[owner] * there.ravel()[by, None], heads, axis=0)
        right = emit[inner + 1] * beta[inner + 1]
        each = (alpha[inner] @ move * right).sum(axis=1, keepdims=True)
        gt = (alpha[inner] / each).T @ right * move - counts
        grads = [gw / n_rows + decay * w, gt / n_rows + decay * tr, diff[firsts].sum(axis=0) / n_rows, diff[lasts].sum(axis=0) / n_rows]
        for x, g, (m, v) in zip((w, tr, st, en), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((1 << FEATURE_BITS, n_labels), np.float32)
    weights[used] = w[:-1]
    return finish(weights, tr, st, en)


def viterbi(model: Model, emit: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Best labels of the segments [starts, ends) of emit, all segments together.

    opens and closes: (segment, label) scores of what comes before and after.
    """
    labels = np.zeros(len(emit), np.int64)
    if len(starts) == 0:
        return labels
    order = np.argsort(starts - ends, kind="stable")
    s, size, opens, closes = starts[order], (ends - starts)[order], opens[order], closes[order]
    n = len(s)
    score = opens + emit[s]
    back: list[np.ndarray] = []
    active = n
    final = np.zeros(n, np.int64)
    for k in range(1, int(size[0]) + 1):
        still = int(np.searchsorted(-size, -k, "left"))  # segments longer than k
        final[still:active] = (score[still:active] + closes[still:active]).argmax(axis=1)
        active = still
        if not active:
            break
        reach = score[:active, :, None] + model.transitions[None]
        best = reach.argmax(axis=1)
        back.append(best)
        score[:active] = np.take_along_axis(reach, best[:, None, :], 1)[:, 0] + emit[s[:active] + k]
    now = final
    labels[s + size - 1] = now
    for k in range(int(size[0]) - 1, 0, -1):
        longer = int(np.searchsorted(-size, -k, "left"))
        now[:longer] = back[k - 1][np.arange(longer), now[:longer]]
        labels[s[:longer] + k - 1] = now[:longer]
    return labels


def decode(model: Model, t: Tokens) -> np.ndarray:
    """The best label of every token; equals Viterbi over each whole text."""
    n = len(t.rows)
    labels = np.zeros(n, np.int64)
    if n == 0:
        return labels
    if model.plain_is_outside:
        odd = np.zeros(n + 4, bool)
        odd[2:-2] = (t.shape != PLAIN) | (t.colons > 0) | (t.run > 0) | np.isin(t.gap, (ADJACENT, EQUALS, COMMA))
        look = np.flatnonzero(odd[:-4] | odd[1:-3] | odd[2:-2] | odd[3:-1] | odd[4:])
    else:
        look = np.arange(n)
    if len(look) == 0:
        return labels
    emit = model.weights[features(t, look)].sum(axis=1, dtype=np.float64)
    open_ = emit[:, 0] - emit[:, 1:].max(axis=1) <= model.margin
    look, emit = look[open_], emit[open_]
    if len(look) == 0:
        return labels
    new = np.ones(len(look), bool)
    new[1:] = (look[1:] != look[:-1] + 1) | (t.rows[look[1:]] != t.rows[look[:-1]])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(look)]])
    a, b = look[starts], look[ends - 1]
    at_start = (a == 0) | (t.rows[np.maximum(a - 1, 0)] != t.rows[a])
    at_end = (b == n - 1) | (t.rows[np.minimum(b + 1, n - 1)] != t.rows[b])
    opens = np.where(at_start[:, None], model.start[None], model.transitions[0][None])
    closes = np.where(at_end[:, None], model.end[None], model.transitions[:, 0][None])
    labels[look] = viterbi(model, emit, starts, ends, opens, closes)
    return labels


def entities(labels: np.ndarray, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, last token, kind, row); an I that continues nothing begins an entity."""
    kind = np.where(labels > 0, (labels - 1) // 2, -1)
    begin = (labels > 0) & ((labels - 1) % 2 == 0)
    before = np.concatenate([[-1], kind[:-1]])
    row_before = np.concatenate([[-1], t.rows[:-1]])
    begin |= (labels > 0) & ((before != kind) | (row_before != t.rows))
    first = np.flatnonzero(begin)
    inside = np.flatnonzero(labels > 0)
    last = inside[np.searchsorted(inside, np.concatenate([first[1:], [len(labels)]]), "left") - 1] if len(first) else first
    return first, last, kind[first], t.rows[first]


def _finder(model: Model):
    names = np.array(KINDS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.as_array(batch.column(1))
            for lo, hi in tv.row_chunks(texts):
                buf, off = tv.buffers(texts.slice(lo, hi - lo))
                t = tokenise(buf, off)
                first, last, kind, row = entities(decode(model, t), t)
                if len(first):
                    a, b = t.starts[first], t.ends[last]
                    shapes = [_SHAPE[buf[i:j]].tobytes().decode() for i, j in zip(a, b, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(names[kind]), pa.array(a - off[row]), pa.array(b - a, pa.int32()), pa.array(shapes)], names=["doc_id", "kind", "start", "length", "shape"])

    return find


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per entity: RESULT; start and length count UTF-8 bytes of the text.

    shape is the entity with letters read as a and digits as 9, so the result
    holds no personal data. Without a model one is trained here, on the driver,
    from labelled_table(). Null and empty texts give no rows, null ids stay null,
    repeated rows report each, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_finder(model or train()), RESULT)
