"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes has an error budget of k = floor(rate * n) edits. Cut
into k + 1 pieces, any text within k edits of it holds at least one piece
unchanged. Pieces are looked up in whole documents through a vectorised hash of
their first 8 bytes (4, 2 or 1 where an item's pieces are shorter); every piece hit opens a window of the document, and Myers'
bit-parallel algorithm gives the exact least edit distance of the item to any
substring of that window, for all windows of a batch at once.

Items and documents are compared as lower-case UTF-8 in which every run of other
bytes than letters and digits is one space; an edit is one byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

RESULT = "doc_id bigint, item_id bigint, distance int, error_budget int, match_end bigint"
#: Bytes of a piece that are looked up: the most that the shortest piece of the item has.
PREFIXES = (8, 4, 2, 1)
#: Items of fewer bytes are matched as whole words, without an error budget.
WHOLE_WORD = 8
_FILTER_BITS = 20
_HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Pieces:
    """Pieces that are looked up by a prefix of `size` bytes, sorted by it."""

    size: int
    prefixes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    length: np.ndarray
    table: np.ndarray


@dataclass(frozen=True)
class Items:
    """Normalised items, their budgets and their pieces by prefix size."""

    ids: tuple[int | None, ...]
    texts: tuple[bytes, ...]
    budgets: np.ndarray
    pieces: tuple[Pieces, ...]
    short: tuple[int, ...]
    lengths: np.ndarray

    def named(self, which: np.ndarray) -> pa.Array:
        return pa.array(self.ids, pa.int64()).take(pa.array(which))


def normalise(text: str | None) -> bytes:
    """The normal form of one text, without the outer spaces."""
    buf, _ = tv.normalised(tv.as_array(pa.array([text], pa.string())), tv.ALNUM)
    return buf.tobytes().strip(b" ")


def cut_items(rows: list[tuple[int | None, str | None]], rate: float) -> Items:
    """Items from (item_id, text), each with a budget of floor(rate * bytes) and one piece more than that.

    Items under WHOLE_WORD bytes are matched exactly, as whole words; items without
    letters or digits, or with null text, match nothing. A budget is always less
    than the item's bytes, so that every piece has one.
    """
    ids, texts, budgets, short = [], [], [], []
    pieces: dict[int, list] = {n: [] for n in PREFIXES}
    for item_id, text in rows:
        norm = normalise(text)
        if not norm:
            continue
        k = len(ids)
        ids.append(item_id)
        texts.append(norm)
        if len(norm) < WHOLE_WORD:
            budgets.append(0)
            short.append(k)
            continue
        budget = min(int(len(norm) * rate), len(norm) - 1)
        budgets.append(budget)
        edges = [len(norm) * i // (budget + 1) for i in range(budget + 2)]
        least = min(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
        pieces[next(n for n in PREFIXES if n <= least)] += [(norm[a:b], k, a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    made = []
    for n, mine in pieces.items():
        if not mine:
            continue
        mine.sort(key=lambda p: int.from_bytes(p[0][:n], "little"))  # noqa: B023
        table = np.zeros((len(mine), max(len(p[0]) for p in mine)), np.uint8)
        for i, p in enumerate(mine):
            table[i, : len(p[0])] = np.frombuffer(p[0], np.uint8)
        made.append(Pieces(n, np.array([int.from_bytes(p[0][:n], "little") for p in mine], np.uint64), *(np.array(x, np.int64) for x in zip(*[(p[1], p[2], len(p[0])) for p in mine], strict=True)), table))
    return Items(tuple(ids), tuple(texts), np.array(budgets, np.int64), tuple(made), tuple(short), np.array([len(t) for t in texts], np.int64))


def myers(patterns: list[bytes], which: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of patterns[which[i]] to any substring of buf[starts[i]:ends[i]], and the first end position that has it.

    All windows advance together, one byte a step; a pattern takes as many 64-bit
    words as it needs, with carries passed between them.
    """
    n = len(which)
    distance, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return distance, place
    sizes = np.array([len(p) for p in patterns], np.int64)
    words = (sizes + 63) // 64
    for w in np.unique(words[which]):
        group = np.flatnonzero(words[which] == w)
        used, local = np.unique(which[group], return_inverse=True)
        peq = np.zeros((len(used), 256, w), np.uint64)
        for u, p in enumerate(used):
            for i, byte in enumerate(patterns[p]):
                peq[u, byte, i >> 6] |= np.uint64(1 << (i & 63))
        last_bit = ((sizes[used] - 1) & 63).astype(np.uint64)[local]
        order = np.argsort(starts[group] - ends[group], kind="stable")  # longest window first
        group, local, last_bit = group[order], local[order], last_bit[order]
        s, length = starts[group], ends[group] - starts[group]
        m = len(group)
        pv, mv = np.full((w, m), ~np.uint64(0)), np.zeros((w, m), np.uint64)
        score = sizes[which[group]].copy()
        best, where = score.copy(), s.copy()
        one = np.uint64(1)
        active = m
        for t in range(int(length[0]) if m else 0):
            while active and length[active - 1] <= t:
                active -= 1
            if not active:
                break
            a = slice(0, active)
            eq_all = peq[local[a], buf[s[a] + t]]
            add, sub = np.zeros(active, np.uint64), np.zeros(active, np.uint64)  # the first row is free: no carry in
            for j in range(w):
                eq, p, q = eq_all[:, j], pv[j, a], mv[j, a]
                xv = eq | q
                eq = eq | sub
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = q | ~(xh | p), p & xh
                if j == w - 1:
                    score[a] += ((ph >> last_bit[a]) & one).astype(np.int64) - ((mh >> last_bit[a]) & one).astype(np.int64)
                hi_p, hi_m = ph >> np.uint64(63), mh >> np.uint64(63)
                ph = (ph << one) | add
                mh = (mh << one) | sub
                add, sub = hi_p, hi_m
                pv[j, a] = mh | ~(xv | ph)
                mv[j, a] = ph & xv
            better = score[a] < best[a]
            best[a] = np.where(better, score[a], best[a])
            where[a] = np.where(better, s[a] + t + 1, where[a])
        distance[group], place[group] = best, where
    return distance, place


def lookup_tables(items: Items) -> tuple[np.ndarray, ...]:
    """For each set of pieces which hashes of a prefix occur."""
    out = []
    for p in items.pieces:
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(p.prefixes * _HASH >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        out.append(seen)
    return tuple(out)


def _windows(buf: np.ndarray, size: int) -> np.ndarray:
    """Every window of `size` bytes as a little-endian integer."""
    kind = {1: np.uint8, 2: "<u2", 4: "<u4", 8: "<u8"}[size]
    return np.lib.stride_tricks.as_strided(np.ascontiguousarray(buf), (len(buf) - size + 1, size), (1, 1)).copy().view(kind).ravel().astype(np.uint64, copy=False)


def _hits(items: Items, p: Pieces, seen: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, begin, end) of the windows that the pieces of one set open."""
    v = _windows(buf, p.size)
    hit = np.flatnonzero(seen[(v * _HASH >> np.uint64(64 - _FILTER_BITS)).view(np.int64)])
    lo, hi = np.searchsorted(p.prefixes, v[hit], "left"), np.searchsorted(p.prefixes, v[hit], "right")
    n = hi - lo
    at = np.repeat(hit, n)
    piece = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    size = p.length[piece]
    fits = at + size <= len(buf)
    at, piece, size = at[fits], piece[fits], size[fits]
    for j in range(p.size, p.table.shape[1]):  # the bytes after the prefix
        if not len(at):
            break
        keep = (j >= size) | (buf[np.minimum(at + j, len(buf) - 1)] == p.table[piece, j])
        at, piece, size = at[keep], piece[keep], size[keep]
    row = np.searchsorted(off, at, "right") - 1
    inside = at + size <= off[row + 1]
    at, piece, row = at[inside], piece[inside], row[inside]
    item = p.item[piece]
    k = items.budgets[item]
    start = np.maximum(off[row], at - p.at[piece] - k)
    stop = np.minimum(off[row + 1], at - p.at[piece] + items.lengths[item] + k)
    return row, item, start, stop


def candidates(items: Items, tables: tuple[np.ndarray, ...], buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, begin, end) of every window of buf that a piece hit opens."""
    rows, which, begin, end = [], [], [], []
    found = [_hits(items, p, seen, buf, off) for p, seen in zip(items.pieces, tables, strict=True) if len(buf) >= p.size]
    if found:
        row, item, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
        # Windows of one row and item that begin in one place or overlap by far become one window.
        order = np.lexsort((start, item, row))
        row, item, start, stop = row[order], item[order], start[order], stop[order]
        if len(row):
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 2 * items.budgets[item[1:]])
            head = np.flatnonzero(new)
            rows, which, begin, end = row[head], item[head], start[head], np.maximum.reduceat(stop, head)
    for s in items.short:
        word = np.frombuffer(b" " + items.texts[s] + b" ", np.uint8)
        if len(buf) < len(word):
            continue
        same = np.ones(len(buf) - len(word) + 1, bool)
        for j, byte in enumerate(word):
            same &= buf[j : j + len(same)] == byte
        at = np.flatnonzero(same)
        row = np.searchsorted(off, at, "right") - 1
        ok = at + len(word) <= off[row + 1]
        rows, which = np.concatenate([rows, row[ok]]), np.concatenate([which, np.full(ok.sum(), s)])
        begin, end = np.concatenate([begin, at[ok] + 1]), np.concatenate([end, at[ok] + len(word) - 1])
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.asarray(x, np.int64) for x in (rows, which, begin, end))


_Q, _GRAM_BITS = 5, 13


def _gram_codes(buf: np.ndarray) -> np.ndarray:
    """A hash of every window of _Q bytes; the last places wrap into zeros."""
    tail = np.concatenate([buf, np.zeros(_Q - 1, np.uint8)]).astype(np.uint64)
    g = np.zeros(len(buf), np.uint64)
    for j in range(_Q):
        g = (g << np.uint64(8)) | tail[j : j + len(buf)]
    return (g * _HASH >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)


def may_match(items: Items, which: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """False only where the q-gram lemma rules a match out.

    k edits spoil at most k * q of the n - q + 1 q-grams of an item, so a window
    must have at least n - q + 1 - k * q places whose q-gram is one of the item's.
    codes are those of the buffer that starts and ends point into. The q-grams of
    the items that have a window here are tabulated, a block of items at a time.
    """
    out = np.ones(len(which), bool)
    least = items.lengths - _Q + 1 - items.budgets * _Q
    open_ = np.flatnonzero(least[which] > 0)
    used, local = np.unique(which[open_], return_inverse=True)
    order = np.argsort(local, kind="stable")
    for lo in range(0, len(used), 512):
        table = np.zeros((min(512, len(used) - lo), 1 << _GRAM_BITS), bool)
        for i, u in enumerate(used[lo : lo + 512]):
            text = np.frombuffer(items.texts[u], np.uint8)
            table[i, _gram_codes(text)[: len(text) - _Q + 1]] = True
        mine = order[np.searchsorted(local[order], lo) : np.searchsorted(local[order], lo + 512)]
        row, at = local[mine] - lo, open_[mine]
        size = ends[at] - starts[at]
        first = np.cumsum(size) - size
        shared = table.ravel()[np.repeat(row << _GRAM_BITS, size) + codes[np.repeat(starts[at] - first, size) + np.arange(size.sum())]]
        out[at] = np.add.reduceat(shared, first, dtype=np.int32) >= least[which[at]]
    return out


def match_rows(items: Items, tables: tuple[np.ndarray, ...], texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, item, distance, end within the row) of the best match of every item in every row, within its budget.

    Windows are gathered over all chunks of the batch, so that Myers' algorithm
    advances as many as there are at every step.
    """
    gathered: list[tuple[np.ndarray, ...]] = []
    parts: list[np.ndarray] = []
    for start, stop in tv.row_chunks(texts):
        buf, off = tv.normalised(texts.slice(start, stop - start), tv.ALNUM)
        row, item, begin, end = candidates(items, tables, buf, off)
        if len(row):
            keep = may_match(items, item, _gram_codes(buf), begin, end)
            row, item, begin, end = row[keep], item[keep], begin[keep], end[keep]
        if len(row):
            size = end - begin
            gathered.append((row + start, item, size, begin - off[row]))
            parts.append(buf[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())])
    if not gathered:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    rows, which, size, offset = (np.concatenate(x) for x in zip(*gathered, strict=True))
    ends = np.cumsum(size)
    starts, text = ends - size, np.concatenate(parts)
    distance, place = myers(list(items.texts), which, text, starts, ends)
    place = place - starts + offset
    good = distance <= items.budgets[which]
    rows, which, distance, place = rows[good], which[good], distance[good], place[good]
    order = np.lexsort((place, distance, which, rows))
    rows, which, distance, place = rows[order], which[order], distance[order], place[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (which[1:] != which[:-1])
    return rows[first], which[first], distance[first], place[first]


def _matcher(items: Items):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup_tables(items)
        for batch in batches:
            row, item, distance, place = match_rows(items, tables, tv.as_array(batch.column(1)))
            if len(row):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), items.named(item), pa.array(distance, pa.int32()), pa.array(items.budgets[item], pa.int32()), pa.array(place)], names=["doc_id", "item_id", "distance", "error_budget", "match_end"])

    return match


def passes(benchmark: DataFrame, rate: float, bytes_per_pass: int) -> Iterator[Items]:
    """The items in blocks of about bytes_per_pass of text: one block is on the driver, and in a Python worker, at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += 4 * len(r[1] or "") + 64
        if size >= bytes_per_pass:
            yield cut_items(block, rate)
            block, size = [], 0
    yield cut_items(block, rate)


def find_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, bytes_per_pass: int = 64 << 20) -> DataFrame:
    """Every (document, item) pair with the item within its error budget, floor(rate * bytes), of some part of the document.

    Columns: RESULT; match_end counts bytes of the document's normal form (with
    its leading space). A pair appears once for each row of docs, with its least
    distance and the first end that has it. The items go to the executors with
    the function, about bytes_per_pass of them in one pass over the documents
    (some 250,000 items of ordinary length); more items make more passes. Null or
    empty texts match nothing; null ids stay null, of documents and of items;
    repeated rows of either table are matched each; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for items in passes(benchmark, rate, bytes_per_pass):
        part = slim.mapInArrow(_matcher(items), RESULT)
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(items: Items, text) -> "F.Column":
    """Whether the text holds any of the items; false for null and empty texts."""
    made: list[tuple[np.ndarray, ...]] = []  # built once per worker, not shipped

    def flag(column: pa.Array) -> pa.Array:
        if not made:
            made.append(lookup_tables(items))
        texts = tv.as_array(column)
        out = np.zeros(len(texts), bool)
        out[match_rows(items, made[0], texts)[0]] = True
        return pa.array(out)

    return F.arrow_udf(flag, "boolean")(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, bytes_per_pass: int = 64 << 20) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay, and so do rows with null or empty text. Repeated rows stay or go together."""
    for items in passes(benchmark, rate, bytes_per_pass):
        docs = docs.where(~contaminated(items, "text"))
    return docs
