"""A navigable small-world graph over Hamming distance, searched for many queries at once.

Nodes are distinct 256-bit codes. Short edges join a node to the nearest nodes
that a search has found, long ones to random nodes. A search enters at the nodes
beside the query in 32 orders of the codes (one for each byte at which the code
may be taken to begin), then follows edges from the best of a beam. All queries
of a block advance together in numpy.
"""

from __future__ import annotations

import numpy as np

BYTES = 32
FAR = 10_000


def words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.uint64).reshape(len(codes), -1)


def hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of broadcast arrays of 64-bit words along the last axis."""
    return np.bitwise_count(q ^ x).sum(axis=-1, dtype=np.int32)


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """The 4 bytes from byte `order` on (wrapping) as a big-endian integer."""
    at = (np.arange(4) + order) % BYTES
    return np.ascontiguousarray(codes[:, at]).view(">u4").ravel().astype(np.uint32)


class SmallWorld:
    def __init__(self, codes: np.ndarray, degree: int = 12, long_edges: int = 4, rounds: int = 1, seed: int = 1):
        """codes: (n, 32) distinct uint8 rows."""
        self.codes, self.words = codes, words(codes)
        self.columns = np.ascontiguousarray(self.words.T)
        n = len(codes)
        self.orders = []
        for o in range(BYTES):
            k = _keys(codes, o)
            by = np.argsort(k, kind="stable")
            self.orders.append((k[by], by.astype(np.int32)))
        rng = np.random.default_rng(seed)
        self.long = rng.integers(0, max(n, 1), (n, long_edges)).astype(np.int32)
        self.edges = np.full((n, 2 * degree + long_edges), -1, np.int32)
        self.edges[:, 2 * degree :] = self.long
        self.degree = degree
        for _ in range(rounds if n > 1 else 0):
            self._link()

    def _link(self) -> None:
        """Joins every node to the nearest that a search finds, and back."""
        n, d = len(self.codes), self.degree
        near, far = np.full((n, d), -1, np.int32), np.full((n, d), FAR, np.int32)
        for lo in range(0, n, 2048):
            hi = min(n, lo + 2048)
            ids, dist = self.search(self.codes[lo:hi], beam=d + 1, width=2, horizon=FAR if self.edges[0, 0] >= 0 else -1)
            own = ids == np.arange(lo, hi)[:, None]
            dist = np.where(own | (ids < 0), FAR, dist)
            by = np.argsort(dist, axis=1, kind="stable")[:, :d]
            near[lo:hi], far[lo:hi] = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
        near[far >= FAR] = -1
        src = np.repeat(np.arange(n, dtype=np.int32), d)
        dst, dist = near.ravel(), far.ravel()
        ok = dst >= 0
        src, dst, dist = src[ok], dst[ok], dist[ok]
        # Reverse edges, the nearest first, into the second half of a node's places.
        by = np.lexsort((dist, dst))
        d2, s2 = dst[by], src[by]
        rank = np.arange(len(d2)) - np.searchsorted(d2, d2, "left")
        keep = rank < d
        self.edges[:, :d] = near
        self.edges[:, d : 2 * d] = -1
        self.edges[d2[keep], d + rank[keep]] = s2[keep]

    def distances(self, qw: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Distances of each query's words to its nodes: (queries, nodes), a word at a time."""
        out = np.bitwise_count(qw[:, 0, None] ^ self.columns[0][ids]).astype(np.int32)
        for k in range(1, len(self.columns)):
            out += np.bitwise_count(qw[:, k, None] ^ self.columns[k][ids])
        return out

    def entries(self, q: np.ndarray, width: int) -> np.ndarray:
        """Nodes beside each query in each of the orders: (queries, 32 * 2 * width)."""
        n = len(self.codes)
        out = np.empty((len(q), BYTES, 2 * width), np.int32)
        step = np.arange(-width, width)
        for o, (keys, by) in enumerate(self.orders):
            at = np.searchsorted(keys, _keys(q, o))
            out[:, o] = by[np.clip(at[:, None] + step, 0, n - 1)]
        return out.reshape(len(q), -1)

    @staticmethod
    def _best(ids: np.ndarray, dist: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The beam nearest distinct ids of each row; of equal ids the expanded one stays."""
        key = (dist.astype(np.int64) << 33) | (ids.astype(np.int64) & 0xFFFFFFFF) << 1 | (~done).astype(np.int64)
        width = min(key.shape[1], 4 * beam)
        if key.shape[1] > width:
            part = np.partition(key, width - 1, axis=1)[:, :width]
            part.sort(axis=1)
            same = (part[:, 1:] >> 1) == (part[:, :-1] >> 1)
            if (width - same.sum(axis=1) < beam).any():
                part = np.sort(key, axis=1)
                same = (part[:, 1:] >> 1) == (part[:, :-1] >> 1)
        else:
            part = np.sort(key, axis=1)
            same = (part[:, 1:] >> 1) == (part[:, :-1] >> 1)
        part[:, 1:][same] = np.int64(FAR + 1) << 33
        part.sort(axis=1)
        part = part[:, :beam]
        dist = (part >> 33).astype(np.int32)
        ids = ((part >> 1) & 0xFFFFFFFF).astype(np.int64).astype(np.int32)
        empty = dist > FAR
        return np.where(empty, -1, ids), np.where(empty, FAR, dist), empty | ((part & 1) == 0)

    def search(self, q: np.ndarray, beam: int, width: int, horizon: int, expand: int = 4, beyond: bool = True, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam nearest nodes found; ids are -1 where there are fewer.

        Only nodes within the horizon are expanded: beyond it random codes lie,
        whose neighbours are as far. beyond: whether such nodes are returned too.
        more: further nodes to enter at for each query, -1 for none.
        """
        n_q, n = len(q), len(self.codes)
        if n == 0 or n_q == 0:
            return np.full((n_q, beam), -1, np.int32), np.full((n_q, beam), FAR, np.int32)
        qw = words(q)
        ids = self.entries(q, width)
        dist = self.distances(qw, ids)
        if more is not None:
            ids, dist = np.concatenate([ids, more], axis=1), np.concatenate([dist, np.where(more < 0, FAR, self.distances(qw, np.maximum(more, 0)))], axis=1)
        if not beyond:  # most queries have nothing near: no more is done for them
            near = dist <= horizon
            some = np.flatnonzero(near.any(axis=1))
            if len(some) < n_q:
                out_ids, out_dist = np.full((n_q, beam), -1, np.int32), np.full((n_q, beam), FAR, np.int32)
                if len(some):
                    out_ids[some], out_dist[some] = self._expand(q[some], ids[some], dist[some], beam, horizon, expand)
                return out_ids, out_dist
        return self._expand(q, ids, dist, beam, horizon, expand)

    def _expand(self, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, beam: int, horizon: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        qw = words(q)
        ids, dist, done = self._best(ids, dist, np.zeros(ids.shape, bool), beam)
        if ids.shape[1] < beam:
            grow = ((0, 0), (0, beam - ids.shape[1]))
            ids, dist, done = np.pad(ids, grow, constant_values=-1), np.pad(dist, grow, constant_values=FAR), np.pad(done, grow, constant_values=True)
        done |= dist > horizon
        active = np.flatnonzero((~done).any(axis=1))
        while len(active):
            i, d, x = ids[active], dist[active], done[active]
            pick = np.argsort(x, axis=1, kind="stable")[:, :expand]  # the nearest that aren't expanded
            fresh = ~np.take_along_axis(x, pick, 1)
            node = np.where(fresh, np.take_along_axis(i, pick, 1), 0)
            np.put_along_axis(x, pick, True, 1)
            near = np.where(fresh[:, :, None], self.edges[node], -1).reshape(len(active), -1)
            far = np.where(near < 0, FAR, self.distances(qw[active], np.maximum(near, 0)))
            i, d, x = self._best(np.concatenate([i, near], 1), np.concatenate([d, far], 1), np.concatenate([x, np.zeros(near.shape, bool)], 1), beam)
            x |= d > horizon
            ids[active], dist[active], done[active] = i, d, x
            active = active[(~x).any(axis=1)]
        return ids, dist

    def within(self, q: np.ndarray, radius: int, beam: int, width: int, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of all nodes found within the radius.

        The beam doubles for queries all of whose beam lies within the radius, until
        it holds a node beyond it or every node.
        """
        found = []
        todo = np.arange(len(q))
        while len(todo):
            wide = []
            block = max(16, 2048 * 16 // max(beam, 16))
            for lo in range(0, len(todo), block):
                mine = todo[lo : lo + block]
                ids, dist = self.search(q[mine], beam, width, horizon, beyond=False)
                full = (dist <= radius).all(axis=1) & (beam < len(self.codes))
                wide.append(mine[full])
                r, c = np.nonzero((dist <= radius) & ~full[:, None])
                found.append((mine[r], ids[r, c], dist[r, c]))
            todo = np.concatenate(wide)
            beam *= 2
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def exact(self, q: np.ndarray, radius: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """within(), by comparing with every node, or with the nodes `only`."""
        qw, x, out = words(q), self.columns if only is None else np.ascontiguousarray(self.columns[:, only]), []
        for lo in range(0, len(q), 64):
            for at in range(0, x.shape[1], 2048):
                d = np.zeros((len(qw[lo : lo + 64]), len(x[0, at : at + 2048])), np.uint16)
                for k in range(len(x)):
                    d += np.bitwise_count(qw[lo : lo + 64, k, None] ^ x[k, at : at + 2048])
                r, c = np.nonzero(d <= radius)
                out.append((r + lo, c + at if only is None else only[c + at], d[r, c].astype(np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
