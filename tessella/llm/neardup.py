"""SimHash near-duplicates through navigable small-world graphs.

1. Every document gets a 256-bit SimHash and a one-permutation MinHash of 128
   places of 4 bits over its distinct word pairs (96 bytes; text is read once).
2. Distinct fingerprints are spread over shards; each shard builds a small-world
   graph over Hamming distance and unites its own texts into local classes along
   verified edges of the graph. Every fingerprint is sent to every shard and
   searched there with expanding beams, which enter at the codes whose MinHashes
   agree in four places of 32 fours; candidates are verified on the spot by
   the MinHash estimate of the Jaccard similarity, and one verified link to each
   local class that has any is returned. A beam grows while it is full and finds
   new classes, so a group of many copies costs each member a few steps and not
   its square.
3. Each shard first answers an audit sample exactly; while the mean recall of
   linked classes is under the target, the search is widened, and in the end made
   exact.
4. The links are unioned into groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import textvec as tv
from tessella.llm.components import components, roots
from tessella.llm.smallworld import BYTES, SmallWorld, hamming, words
from tessella.llm.storage import BROADCAST_BYTES, join_hot, join_measured, write_table

PLACES = 128
#: Bytes of a sketch: two places each.
MARK = PLACES // 2
#: Bits of 256 by which near-duplicates may differ: 95 % of pairs at the threshold of 0.5 lie within (68.5 bits on average, 7.1 standard deviation).
RADIUS = 80
HORIZON = 96
#: (beam, width, most) of the searches tried in turn before the exact one.
LADDER = ((16, 0, 32), (32, 4, 64), (64, 16, 128), (128, 32, 256), (256, 64, 512), (512, 128, 1024))
#: Places that a bucket's texts agree in; the buckets of each text.
AGREE, BANDS = 4, PLACES // 4
#: Texts that use at most so many places are compared with all that may be similar to them.
TINY = 8
#: Planted codes of the audit have up to so many partners.
FEW = 8
FINGERPRINTS = "code binary, sketch binary"
_LINK = "a bigint, b bigint, link boolean"

_LANES = np.zeros((256, 8), np.uint8)
for _b in range(8):
    _LANES[:, _b] = (np.arange(256) >> (7 - _b)) & 1
_LANES = _LANES.view(np.uint64).ravel()


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct pairs of neighbouring words of each row, or of the word where a text has only one."""
    h, rows = tv.word_tokens(texts)
    if len(h) == 0:
        return h, rows
    pair = tv.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    both = rows[1:] == rows[:-1]
    alone = np.ones(len(h), bool)
    alone[1:] &= ~both
    alone[:-1] &= ~both
    out = np.concatenate([pair[both], tv.mix(h[alone] + np.uint64(1))])
    out_rows = np.concatenate([rows[:-1][both], rows[alone]])
    # Each pair once a row: sorted by row and the upper bits of the hash.
    spare = np.uint64(max(1, int(out_rows.max()).bit_length()))
    key = (out_rows.astype(np.uint64) << (np.uint64(64) - spare)) | (out >> spare)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    order = order[new]
    return out[order], out_rows[order]


def simhashes(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, 32) bytes: bit j is set where more than half of a row's shingle hashes have it.

    Each hash is stretched to 256 bits. Bits are counted in byte lanes of 64-bit
    words, at most 255 hashes at a time, so that one addition counts eight bits.
    """
    out = np.zeros((n, BYTES), np.uint8)
    if len(h) == 0:
        return out
    first = np.searchsorted(rows, np.arange(n))
    size = np.diff(np.concatenate([first, [len(rows)]]))
    counts = np.zeros((n, 256), np.int32)
    pieces = np.maximum(1, -(-size // 255)) * (size > 0)
    owner = np.repeat(np.arange(n), pieces)
    start = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(start + 255, first[owner] + size[owner])
    at = 0
    while at < len(owner):  # blocks of about 32,000 hashes
        to = max(at + 1, int(np.searchsorted(stop, start[at] + 32_768, "right")))
        lo, hi = start[at], stop[to - 1]
        wide = np.stack([tv.mix(h[lo:hi] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(4)], axis=1)
        lanes = _LANES[wide.view(np.uint8)]
        sums = np.add.reduceat(lanes, start[at:to] - lo, axis=0)
        np.add.at(counts, owner[at:to], sums.view(np.uint8).reshape(to - at, 256).astype(np.int32))
        at = to
    return np.packbits(2 * counts > size[:, None], axis=1)


def sketches(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, MARK) bytes: the least hash of each of 128 classes of shingles, in 4 bits; 0 where a class is empty."""
    least = np.full(n * PLACES, np.iinfo(np.uint64).max, np.uint64)
    g = tv.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    np.minimum.at(least, rows * PLACES + (g & np.uint64(PLACES - 1)).astype(np.int64), g >> np.uint64(7))
    out = ((tv.mix(least) >> np.uint64(32)) % np.uint64(15)).astype(np.uint8) + np.uint8(1)
    out[least == np.iinfo(np.uint64).max] = 0
    return out[0::2].reshape(n, MARK) << 4 | out[1::2].reshape(n, MARK)


#: Of a byte of either sketch and of their difference: places that either uses, places that agree though empty or not.
_NIBBLE_USED = np.array([(x > 15) + (x & 15 > 0) for x in range(256)], np.uint8)
_NIBBLE_SAME = np.array([(x < 16) + (x & 15 == 0) for x in range(256)], np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, corrected for chance agreement in 4 bits."""
    used = _NIBBLE_USED[a | b].sum(axis=-1, dtype=np.int32)
    same = _NIBBLE_SAME[a ^ b].sum(axis=-1, dtype=np.int32) - (PLACES - used)
    return np.maximum(0, (same / np.maximum(used, 1) - 1 / 15) / (1 - 1 / 15))


def _used(marks: np.ndarray) -> np.ndarray:
    """The number of places that each sketch uses."""
    return np.concatenate([np.zeros(0, np.int32), *(_NIBBLE_USED[marks[lo : lo + 65_536]].sum(axis=1, dtype=np.int32) for lo in range(0, len(marks), 65_536))])


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros((0, width), np.uint8)
    _, off, data = column.buffers()
    at = int(np.frombuffer(off, np.int64, 1, column.offset * 8)[0])
    return np.frombuffer(data, np.uint8, len(column) * width, at).reshape(-1, width)


def _fingerprint(column: pa.Array) -> pa.Array:
    texts = tv.as_array(column)
    codes, marks, blank = [np.zeros((0, BYTES), np.uint8)], [np.zeros((0, MARK), np.uint8)], [np.zeros(0, bool)]
    for lo, hi in tv.row_chunks(texts):
        h, rows = shingles(texts.slice(lo, hi - lo))
        codes.append(simhashes(h, rows, hi - lo))
        marks.append(sketches(h, rows, hi - lo))
        blank.append(np.bincount(rows, minlength=hi - lo) == 0)
    none = pa.array(np.concatenate(blank))
    both = pa.StructArray.from_arrays([_fixed(np.concatenate(codes)), _fixed(np.concatenate(marks))], names=["code", "sketch"], mask=none)
    return both


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, row (a number of the row), code, sketch and node (a hash of both); these three are null for texts without words."""
    both = F.arrow_udf(_fingerprint, FINGERPRINTS)(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), both.alias("f"))
    return rows.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), F.col("f.code").alias("code"), F.col("f.sketch").alias("sketch"), F.when(F.col("f.code").isNotNull(), F.xxhash64("f.code", "f.sketch")).alias("node"))


def _nibbles(marks: np.ndarray) -> np.ndarray:
    """(n, PLACES) values of sketches, 0 where a class is empty."""
    return np.stack([marks >> 4, marks & 15], axis=2).reshape(len(marks), PLACES)


def buckets(marks: np.ndarray) -> np.ndarray:
    """(n, BANDS) numbers under 65,536: the values of AGREE places each, every place used once.

    An empty place takes the value of the next one that isn't, turned by how far
    that is, so that short texts too agree in a place as often as they are similar.
    """
    v = _nibbles(marks)
    at = np.where(v > 0, np.arange(PLACES, dtype=np.int16), np.int16(2 * PLACES))
    follows = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    follows = np.where(follows < PLACES, follows, follows[:, :1] + PLACES)
    away = follows - np.arange(PLACES, dtype=np.int16)
    full = (np.take_along_axis(v, follows % PLACES, axis=1) + 7 * away) % 15
    four = full[:, np.random.default_rng(6).permutation(PLACES)].reshape(len(v), BANDS, AGREE).astype(np.int32)
    return four[:, :, 0] << 12 | four[:, :, 1] << 8 | four[:, :, 2] << 4 | four[:, :, 3]


class Buckets:
    """The codes of texts by the buckets of their sketches."""

    def __init__(self, marks: np.ndarray, point: np.ndarray):
        n = len(marks)
        self.first, self.points = np.zeros((BANDS, 65_537), np.int32), np.empty((BANDS, n), np.int32)
        keys = np.concatenate([np.zeros((0, BANDS), np.uint16), *(buckets(marks[lo : lo + 65_536]).astype(np.uint16) for lo in range(0, n, 65_536))])
        for b in range(BANDS):
            k = np.ascontiguousarray(keys[:, b])
            self.points[b] = point[np.argsort(k, kind="stable")]
            self.first[b, 1:] = np.cumsum(np.bincount(k, minlength=65_536))

    def entries(self, marks: np.ndarray, qw: np.ndarray, words: np.ndarray, most: int, horizon: int, wide: int) -> np.ndarray:
        """(queries, up to wide): the nearest codes within the horizon of up to `most` texts a bucket, evenly chosen of more; -1 where there are fewer."""
        keys, band = buckets(marks), np.arange(BANDS)
        lo = self.first[band, keys].ravel()
        have = self.first[band, keys + 1].ravel() - lo
        size = np.minimum(have, most)
        end = np.cumsum(size)
        cell = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(cell)) - (end - size)[cell]
        step = np.where(have[cell] > most, step * have[cell] // most, step)
        q, at = cell // BANDS, self.points[cell % BANDS, lo[cell] + step]
        dist = np.concatenate([np.zeros(0, np.int32), *(hamming(qw[q[i : i + 65_536]], words[at[i : i + 65_536]]) for i in range(0, len(q), 65_536))])
        near = np.flatnonzero(dist <= horizon)
        key = np.unique((q[near].astype(np.int64) << 41) | (dist[near].astype(np.int64) << 32) | at[near])
        q, at = key >> 41, (key & 0xFFFFFFFF).astype(np.int32)
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < wide
        out = np.full((len(marks), int(rank[keep].max(initial=-1)) + 1), -1, np.int32)
        out[q[keep], rank[keep]] = at[keep]
        return out


class Shard:
    """Texts by (node, code, sketch): a graph over the distinct codes, and local classes of texts that verified edges connect."""

    def __init__(self, nodes: np.ndarray, codes: np.ndarray, marks: np.ndarray, radius: int = RADIUS, threshold: float = 0.5, horizon: int = HORIZON):
        self.radius, self.threshold, self.horizon = radius, threshold, horizon
        points, where = np.unique(np.ascontiguousarray(codes).view(f"V{BYTES}").ravel(), return_inverse=True)
        order = np.argsort(where, kind="stable")
        self.nodes, self.marks, self.point = nodes[order], marks[order], where[order]
        self.first = np.searchsorted(self.point, np.arange(len(points) + 1))
        self.graph = SmallWorld(points.view(np.uint8).reshape(-1, BYTES))
        self.buckets = Buckets(self.marks, self.point)
        # Similar sketches agree in this share of all places that either uses, so neither uses more than the other by its inverse.
        self.tiny = np.unique(self.point[_used(self.marks) <= int(TINY / (threshold * 14 / 15 + 1 / 15) + 1e-9)])
        by = np.argsort(self.nodes, kind="stable")
        self._sorted, self._by = self.nodes[by], by
        a, b = self._edges()
        self.label = roots(a, b, len(nodes)) if len(nodes) else np.zeros(0, np.int64)
        self.partner = np.full(len(nodes), -1)
        self.partner[a], self.partner[b] = b, a
        self.one_class = np.zeros(len(points), bool)
        if len(points):
            self.one_class = np.minimum.reduceat(self.label, self.first[:-1]) == np.maximum.reduceat(self.label, self.first[:-1])

    def _similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.zeros(len(a), bool)
        for lo in range(0, len(a), 65_536):
            good[lo : lo + 65_536] = similarity(self.marks[a[lo : lo + 65_536]], self.marks[b[lo : lo + 65_536]]) >= self.threshold
        return good

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs of own texts: each with the first of its code that it agrees with, and along the graph's short edges."""
        out = [np.zeros((2, 0), np.int64)]
        # Of equal codes: all with the first; those that disagree with the first that did, and so on.
        lead, rest = self.first[:-1].copy(), np.flatnonzero(np.arange(len(self.point)) != self.first[self.point])
        while len(rest):
            good = self._similar(rest, lead[self.point[rest]])
            out.append(np.stack([rest[good], lead[self.point[rest[good]]]]))
            rest = rest[~good]
            p, at = np.unique(self.point[rest], return_index=True)
            lead[p] = rest[at]
            rest = np.delete(rest, at)
        if len(self.graph.codes) > 1:
            short = self.graph.edges[:, : 2 * self.graph.degree]
            for lo in range(0, len(short), 8192):
                u, c = np.nonzero(short[lo : lo + 8192] >= 0)
                u, v = u + lo, short[lo : lo + 8192][u, c]
                near = hamming(self.graph.words[u], self.graph.words[v]) <= self.radius
                u, v = self.first[u[near]], self.first[v[near]]
                good = self._similar(u, v)
                out.append(np.stack([u[good], v[good]]))
        return tuple(np.concatenate(out, axis=1))

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """The place of each node here, or -1."""
        if not len(self.nodes):
            return np.full(len(nodes), -1)
        at = np.clip(np.searchsorted(self._sorted, nodes), 0, len(self._sorted) - 1)
        return np.where(self._sorted[at] == nodes, self._by[at], -1)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Local classes as stars: (node, node of its class's first place)."""
        far = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.nodes[far], self.nodes[self.label[far]]

    def verify(self, marks: np.ndarray, own: np.ndarray, q: np.ndarray, point: np.ndarray, dist: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, label, place): one verified link for each query and local class among the candidates (q, point) that has any.

        known holds keys query * texts + label that need no more link. The nearest
        candidates of a query and class come first; the others are compared only
        while none of them agrees.
        """
        n, out = len(self.label), [np.zeros((3, 0), np.int64)]
        place, q, dist = self.first[point], q, dist
        more = ~self.one_class[point] | (self.first[point + 1] - self.first[point] > 1)
        size = np.where(more, self.first[point + 1] - self.first[point], 1)
        skip = self.one_class[point] & np.isin(q * n + self.label[place], known)
        q, place, size, dist = q[~skip], place[~skip], size[~skip], dist[~skip]
        # Points with several texts: the first text now; the others where their class isn't linked by then.
        rounds = [(q, place, dist)]
        wide = np.flatnonzero(size > 1)
        for k in range(2):
            if k == 1:
                q2 = np.repeat(q[wide], size[wide] - 1)
                p2 = np.repeat(place[wide], size[wide] - 1) + np.arange(len(q2)) - np.repeat(np.cumsum(size[wide] - 1) - (size[wide] - 1), size[wide] - 1) + 1
                rounds.append((q2, p2, np.repeat(dist[wide], size[wide] - 1)))
            rq, rp, rd = rounds[k]
            key = rq * n + self.label[rp]
            order = np.lexsort((rd, key))
            rq, rp, key = rq[order], rp[order], key[order]
            keep = (own[rq] != rp) & ~np.isin(key, known)
            rq, rp, key = rq[keep], rp[keep], key[keep]
            step = 4
            while len(rq):
                rank = np.arange(len(key)) - np.searchsorted(key, key, "left")
                now = rank < step
                good = np.zeros(len(rq), bool)
                at = np.flatnonzero(now)
                for lo in range(0, len(at), 65_536):
                    i = at[lo : lo + 65_536]
                    good[i] = similarity(marks[rq[i]], self.marks[rp[i]]) >= self.threshold
                hit = np.flatnonzero(good)
                hit = hit[np.unique(key[hit], return_index=True)[1]]
                out.append(np.stack([rq[hit], self.label[rp[hit]], rp[hit]]))
                known = np.union1d(known, key[hit])
                left = ~now & ~np.isin(key, key[hit])
                rq, rp, key, step = rq[left], rp[left], key[left], step * 4
        return tuple(np.concatenate(out, axis=1))

    def _own_class(self, own: np.ndarray) -> np.ndarray:
        mine = np.flatnonzero(own >= 0)
        return mine * len(self.label) + self.label[own[mine]]

    def links(self, codes: np.ndarray, marks: np.ndarray, own: np.ndarray, search: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """verify() of what the search (beam, width, most) finds, or of every code within the radius if it is None; own: each query's place here or -1.

        A search enters at `width` codes on either side in each order of the graph
        and at those of up to `most` texts of each of a query's buckets (none if
        left out). Texts beyond that are reached over edges, as the audit measures.
        Whatever the search, queries that use at most TINY places are compared with
        all texts that may be similar to them: these share few buckets with such.
        A query's own class needs no link. The beam doubles for a query whose beam
        lies wholly within the radius, as long as doubling it finds new classes.
        """
        if search is None:
            return self._compare(codes, marks, own, None)
        tiny = _used(marks) <= TINY
        if tiny.any():
            out = []
            for part, found in ((np.flatnonzero(tiny), self._compare(codes[tiny], marks[tiny], own[tiny], self.tiny)), (np.flatnonzero(~tiny), self.links(codes[~tiny], marks[~tiny], own[~tiny], search))):
                out.append(np.stack([part[found[0]], *found[1:]]))
            return tuple(np.concatenate(out, axis=1))
        known = self._own_class(own)
        beam, width, most = (*search, 0)[:3]
        todo, out = np.arange(len(codes)), [np.zeros((3, 0), np.int64)]
        while len(todo):
            wide, found = [], []
            block = max(16, (512 if most else 2048) * 16 // max(beam, 16))
            for lo in range(0, len(todo), block):
                mine = todo[lo : lo + block]
                more = self.buckets.entries(marks[mine], words(codes[mine]), self.graph.words, most, self.horizon, 2 * beam) if most else None
                ids, dist = self.graph.search(codes[mine], beam, width, self.horizon, beyond=False, more=more)
                r, c = np.nonzero((ids >= 0) & (dist <= self.radius))
                found.append((mine[r], ids[r, c].astype(np.int64), dist[r, c]))
                wide.append(mine[(dist <= self.radius).all(axis=1)])
            hits = self.verify(marks, own, *(np.concatenate(x) for x in zip(*found, strict=True)), known)
            out.append(np.stack(hits))
            known = np.union1d(known, hits[0] * len(self.label) + hits[1])
            todo = np.concatenate(wide) if beam < len(self.graph.codes) else todo[:0]
            if len(out) > 2:  # a doubled beam goes on only where it found something
                todo = todo[np.isin(todo, hits[0])]
            beam *= 2
        return tuple(np.concatenate(out, axis=1))

    def _compare(self, codes: np.ndarray, marks: np.ndarray, own: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """verify() of every code within the radius, or of those among the points `only`."""
        known, n = self._own_class(own), len(self.graph.codes) if only is None else len(only)
        step, out = max(1, min(256, (1 << 23) // max(1, n))), [np.zeros((3, 0), np.int64)]  # every code may be a candidate
        for lo in range(0, len(codes), step):
            q, point, dist = self.graph.exact(codes[lo : lo + step], self.radius, only)
            out.append(np.stack(self.verify(marks, own, q + lo, point, dist, known)))
        return tuple(np.concatenate(out, axis=1))

    def settle(self, codes: np.ndarray, marks: np.ndarray, own: np.ndarray, truth: tuple, target: float, enough: int = 300) -> tuple[int, ...] | None:
        """The first (beam, width, most) whose recall reaches the target, None: search exactly.

        truth is what links() gives exactly for the audit sample. Recall is the
        mean share, over the sample's texts that have any, of their links that the
        search finds, and is measured apart for links to local classes of up to
        FEW texts and to larger ones, which are easier to find. Where under
        `enough` texts have links to small classes, planted texts with few
        partners make up the number. Texts of up to TINY places don't count: they
        are never searched for.
        """
        truth = tuple(x[_used(marks)[truth[0]] > TINY] for x in truth)
        size = np.bincount(self.label, minlength=len(self.label))
        some, at = np.unique(truth[0], return_inverse=True)
        small = size[truth[1]] <= FEW
        asked = len(np.unique(truth[0][small]))
        more, more_marks = planted(self, enough - asked, self.threshold) if asked < enough else (codes[:0], marks[:0])
        codes, marks, own = np.concatenate([codes[some], more]), np.concatenate([marks[some], more_marks]), np.concatenate([own[some], np.full(len(more), -1)])
        q, label, _ = self.links(more, more_marks, own[len(some) :], None)
        few = (size[label] <= FEW) & (_used(more_marks)[q] > TINY)
        who, label, small = np.concatenate([at, q[few] + len(some)]), np.concatenate([truth[1], label[few]]), np.concatenate([small, np.ones(few.sum(), bool)])
        for search in LADDER:
            if max(256, 2 * search[1] * BYTES) >= len(self.graph.codes):  # the exact search compares no more
                break
            q, found, _ = self.links(codes, marks, own, search)
            hit = np.isin(who * len(size) + label, q * len(size) + found)
            mean = [np.bincount(who[k & hit], minlength=len(codes))[u] / np.bincount(who[k], minlength=len(codes))[u] for k in (small, ~small) for u in [np.unique(who[k])]]
            if all(m.sum() >= target * len(m) for m in mean):
                return search
        return None


def planted(shard: Shard, n: int, threshold: float, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sketches of n texts with few partners.

    They differ from a text that has few itself as texts do whose similarity
    lies anywhere between the threshold and 1: each place of the sketch agrees as
    often. A code with at most FEW partners has an edge beyond the radius in place
    FEW: no such code is left out.
    """
    rng, graph = np.random.default_rng(seed), shard.graph
    edge = graph.edges[:, FEW]
    pool = np.flatnonzero((edge < 0) | (hamming(graph.words, graph.words[np.maximum(edge, 0)]) > shard.radius))
    if len(pool) == 0:
        return np.zeros((0, BYTES), np.uint8), np.zeros((0, MARK), np.uint8)
    at, alike = rng.choice(pool, n), rng.uniform(threshold, 1, (n, 1))
    codes = graph.codes[at] ^ np.packbits(rng.random((n, 256)) < np.arccos(2 * alike / (1 + alike)) / np.pi, axis=1)
    v = _nibbles(shard.marks[shard.first[at]])
    v = np.where((v > 0) & (rng.random(v.shape) >= alike), rng.integers(1, 16, v.shape, dtype=np.uint8), v)
    return codes, v[:, 0::2] << 4 | v[:, 1::2]


def _searcher(radius: int, threshold: float, horizon: int, target: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (role, node, code, sketch) of one shard: role 0 its own, 1 the audit queries, 2 the other queries."""
        held: dict[int, list] = {0: [], 1: []}
        shard, settings = None, None

        def edges(a: np.ndarray, b: np.ndarray, link: bool) -> pa.RecordBatch:
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(np.full(keep.sum(), link))], names=["a", "b", "link"])

        def answer(nodes: np.ndarray, codes: np.ndarray, marks: np.ndarray, own: np.ndarray, found: tuple) -> pa.RecordBatch:
            inside = np.flatnonzero(own >= 0)
            inside = inside[shard.partner[own[inside]] >= 0]
            return edges(np.concatenate([nodes[found[0]], nodes[inside]]), np.concatenate([shard.nodes[found[2]], shard.nodes[shard.partner[own[inside]]]]), True)

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal shard, settings
            empty = (np.zeros(0, np.int64), np.zeros((0, BYTES), np.uint8), np.zeros((0, MARK), np.uint8))
            shard = Shard(*(np.concatenate(x) for x in zip(*(held[0] or [empty]), strict=True)), radius, threshold, horizon)
            nodes, codes, marks = (np.concatenate(x) for x in zip(*(held[1] or [empty]), strict=True))
            held.clear()
            yield edges(*shard.forest(), False)
            own = shard.places(nodes)
            truth = shard.links(codes, marks, own, None)
            yield answer(nodes, codes, marks, own, truth)
            settings = shard.settle(codes, marks, own, truth, target)
            if settings and not settings[1]:
                shard.graph.orders = []  # nothing enters by them any more

        for batch in batches:
            role, node, code, mark = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _bytes(batch.column(2), BYTES), _bytes(batch.column(3), MARK)
            for r in (0, 1):
                if (role == r).any():
                    held[r].append((node[role == r], code[role == r], mark[role == r]))
            rest = role == 2
            if rest.any():
                if shard is None:
                    yield from ready()
                node, code, mark = node[rest], code[rest], mark[rest]
                own = shard.places(node)
                yield answer(node, code, mark, own, shard.links(code, mark, own, settings))
        if shard is None and held.get(0):
            yield from ready()

    return search


def links(codes: DataFrame, shards: int | None = None, radius: int = RADIUS, threshold: float = 0.5, horizon: int = HORIZON, audit: int = 4000, target: float = 0.95, shard_rows: int = 1_000_000) -> DataFrame:
    """(a, b, link): with link, two texts within the radius and the threshold, found by a's query; without, two of one local class.

    codes has distinct rows (node, code, sketch). Every text is searched in every
    shard; there are at least six shards, and one more for each further
    shard_rows texts (a shard takes about 700 bytes a text). audit is the number
    of texts answered exactly in each shard to measure recall. From each shard a
    query gets one link for each local class that it has any link to, so links
    are at most texts times shards times classes met, and never the pairs of a
    group.
    """
    n = codes.count()
    shards = shards or max(6, -(-n // shard_rows))
    blocks = -(-shards // 4)
    sampled = (F.shiftrightunsigned(F.xxhash64(F.lit(3), "node"), 11).cast("double") / F.lit(float(1 << 53))) < audit * blocks / max(n, 1)
    place = lambda s, b: (s * blocks + b).cast("int").alias("place")
    own = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(place(F.pmod("node", F.lit(shards)), b), F.lit(0).alias("role")))
    block = F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(blocks))
    asks = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(place(s, block), F.when(sampled, 1).otherwise(2).alias("role")))
    sent = codes.select(F.explode(F.concat(own, asks)).alias("s"), "node", "code", "sketch").select("s.place", "s.role", "node", "code", "sketch")
    placed = sent.repartitionById(shards * blocks, F.col("place")).sortWithinPartitions("role", "node").select("role", "node", "code", "sketch")
    return placed.mapInArrow(_searcher(radius, threshold, horizon, target), _LINK)


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, threshold: float = 0.5, shards: int | None = None, hot: int = 1 << 20) -> DataFrame:
    """Every document with its group: doc_id, text_hash, group_id, group_size, n_links, is_representative.

    Two documents are linked if their SimHashes differ in at most radius bits
    and the estimated Jaccard similarity of their sets of word pairs is at least
    threshold; groups are the components. n_links counts the verified links found
    from the document's text, at most one for each local class of each shard. The
    representative is the row with the least (doc_id, text_hash), null ids last,
    and group_id is its doc_id. Exactly one row of a group is the representative:
    of fully repeated rows one. Texts without words (null, empty, signs only) are
    groups of their own. Letter case and signs play no part. Other columns are
    ignored. Groups and texts with more than `hot` documents are split where
    they are joined.
    """
    prints = write_table(fingerprints(docs), "fingerprints")
    named = prints.where("node is not null")
    codes = named.groupBy("node").agg(F.first("code").alias("code"), F.first("sketch").alias("sketch"))
    found = write_table(links(codes, shards, radius, threshold), "links")
    linked = components(found).select("node", "component")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row")
    texts = named.groupBy("node").agg(F.count(F.lit(1)).alias("n_docs"), F.min(best).alias("best"))  # copies of a text meet map-side
    degree = found.where("link").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    texts = write_table(texts.join(linked, "node", "left").join(degree, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "n_docs", "best", F.coalesce("n_links", F.lit(0)).alias("n_links")), "texts")
    groups = write_table(texts.groupBy("component").agg(F.sum("n_docs").alias("group_size"), F.min("best").alias("head"), F.count(F.lit(1)).alias("n_texts")), "groups")
    sized = write_table(join_hot(texts.drop("best"), groups, "component", "n_texts", hot=hot).select("node", "n_docs", "n_links", "group_size", "head"), "sized")
    slim = named.select("node", "doc_id", "text_hash", "row")
    together = join_hot(slim, sized, "node", "n_docs", hot=hot).select("doc_id", "text_hash", F.col("head.doc_id").alias("group_id"), "group_size", "n_links", (F.col("row") == F.col("head.row")).alias("is_representative"))
    alone = prints.where("node is null").select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("is_representative"))
    return together.union(alone)


def keep_representatives(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates; all columns stay.

    Of rows that share doc_id and text with the representative, the one that is
    least as JSON stays. Only the keys of rows that go are joined with docs: they
    are written and measured, broadcast up to broadcast_bytes, so that text is not
    shuffled, and beyond it documents are shuffled once. Nulls and texts without
    words: see near_duplicate_groups.
    """
    each = near_duplicate_groups(docs, **options).groupBy("doc_id", "text_hash").agg(F.max("is_representative").alias("stays"), F.min("is_representative").alias("all_stay"))
    gone = write_table(each.where("not all_stay").select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), "stays"), "gone")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("k1")) & (F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("k2"))
    kept = join_measured(row, gone, on, "left", F.lit(64), broadcast_bytes).where("stays is null").select("row")
    tied = gone.where("stays")
    if not tied.isEmpty():  # repeated rows of a representative: the first of each key, which map-side sorting finds
        least = Window.partitionBy("k1", "k2").orderBy(F.to_json("row"))
        same = join_measured(row, tied, on, "inner", F.lit(64), broadcast_bytes)
        kept = kept.union(same.withColumn("i", F.row_number().over(least)).where("i <= 1").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
