"""Nearest neighbours by inverted lists, with exact search where lists don't pay.

Each shard puts its vectors into cells around centroids, which k-means finds over
a sample of at most 32,768 of them; every vector is in a cell. A query's distances
to the vectors of its nearest cells are matrix products, cell by cell for all
queries of a block, and only what is nearer than a query's nearest so far is kept.
Every query is searched in every shard, and the shards' nearest are merged. Each
shard first answers an audit sample of the queries exactly, and doubles the number
of cells until their recall is reached. Where that is over a third of the cells,
as it is for vectors without clusters, every query is compared with every vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "query_id bigint, neighbor_id bigint, distance float"
#: Most cells of a shard, vectors a cell that k-means is fitted on, least vectors a cell.
CELLS, FITTED, LEAST = 1024, 32, 8
#: Under so many vectors a shard compares all: as many products of small matrices cost more.
SMALL = 16_384


def _roomy(x: np.ndarray) -> np.ndarray:
    """x in the type in which its squares are finite."""
    return x.astype(np.float64 if np.abs(x).max(initial=0) > 1e15 else np.float32)


def _with(x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """x with one more column."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x, last
    return out


class Nearest:
    """The k nearest places of each of m queries, of all that add() is given."""

    def __init__(self, m: int, k: int):
        self.ids, self.dist = np.full((m, k), -1, np.int32), np.full((m, k), np.inf)
        self.far, self.held, self.size = np.full(m, np.inf), [], 0

    def add(self, rows: np.ndarray, first: int, dist: np.ndarray) -> None:
        """dist (rows, c) from the queries rows to the places from first on."""
        k, far = self.ids.shape[1], self.far[rows]
        if dist.shape[1] >= k and np.isinf(far).any():  # k of a row at most, however many tie
            at = np.argpartition(dist, k - 1, axis=1)[:, :k]
            dist = np.take_along_axis(dist, at, 1)
            r, c = np.nonzero(dist < far[:, None])
            self.far[rows] = np.minimum(far, dist[:, -1])
            self.held.append((rows[r], (at[r, c] + first).astype(np.int32), dist[r, c]))
        else:
            r, c = np.nonzero(dist < far[:, None])
            self.held.append((rows[r], (c + first).astype(np.int32), dist[r, c]))
        self.size += len(r)
        if self.size > 1 << 18:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        m, k = self.ids.shape
        rows, ids, dist = (np.concatenate(x) for x in zip((np.repeat(np.arange(m), k), self.ids.ravel(), self.dist.ravel()), *self.held, strict=True))
        by = np.lexsort((ids, dist, rows))
        rows, ids, dist = rows[by], ids[by], dist[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(m))[rows]
        keep = rank < k
        self.ids[rows[keep], rank[keep]], self.dist[rows[keep], rank[keep]] = ids[keep], dist[keep]
        self.far, self.held, self.size = self.dist[:, -1].copy(), [], 0


class Shard:
    """Distinct vectors of one dimension by cells, and the ids that have each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        points, where = np.unique(vectors, axis=0, return_inverse=True)
        points, n = _roomy(points), len(points)
        self.centre = points.mean(axis=0, dtype=np.float64).astype(points.dtype)
        points -= self.centre
        cells = max(1, min(CELLS, n // LEAST))
        sample = points[np.random.default_rng(seed).permutation(n)[: FITTED * cells]]
        self.cells = sample[:cells].copy()
        for _ in range(4):
            label = self._cell(sample)
            by = np.argsort(label, kind="stable")
            have, first = np.unique(label[by], return_index=True)
            self.cells[have] = np.add.reduceat(sample[by], first, axis=0) / np.diff(np.append(first, len(by)))[:, None]
        label = self._cell(points)
        by = np.argsort(label, kind="stable")
        self.start = np.searchsorted(label[by], np.arange(cells + 1))
        points = points[by]
        self.table = _with(points, np.einsum("ij,ij->i", points, points))
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)
        where = place[where.ravel()]
        order = np.lexsort((ids, where))
        self.ids, self.first = ids[order], np.searchsorted(where[order], np.arange(n + 1))

    @property
    def points(self) -> np.ndarray:
        return self.table[:, :-1] + self.centre

    def _cell(self, x: np.ndarray) -> np.ndarray:
        half = np.einsum("ij,ij->i", self.cells, self.cells) / 2
        return np.concatenate([(half - x[lo : lo + 4096] @ self.cells.T).argmin(axis=1) for lo in range(0, len(x), 4096)])

    def _exactly(self, q: np.ndarray, near: Nearest) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of what near has, nearest first; the distances are of differences, without the products' rounding."""
        near.merge()
        dist = ((q[:, None] - self.table[np.maximum(near.ids, 0), :-1]) ** 2).sum(axis=2)
        dist[near.ids < 0] = np.inf
        by = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(near.ids, by, 1), np.take_along_axis(dist, by, 1)

    def exact(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of the k + 1 nearest points, nearest first, by comparing with every one."""
        q = _roomy(vectors) - self.centre
        near, asked, rows = Nearest(len(q), min(k + 1, len(self.table))), _with(-2 * q, 1), np.arange(len(q))
        for lo in range(0, len(self.table), 4096):
            near.add(rows, lo, asked @ self.table[lo : lo + 4096].T)
        return self._exactly(q, near)

    def search(self, vectors: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """exact(), but only in the beam nearest cells of each query; -1 where they hold fewer points."""
        q = _roomy(vectors) - self.centre
        beam = min(beam, len(self.cells))
        near, asked = Nearest(len(q), min(k + 1, len(self.table))), _with(-2 * q, 1)
        far = asked @ _with(self.cells, np.einsum("ij,ij->i", self.cells, self.cells)).T
        mine = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        mine = np.take_along_axis(mine, np.argsort(np.take_along_axis(far, mine, 1), axis=1), 1)
        first = max(1, -(-4 * (k + 1) * len(self.cells) // len(self.table)))  # cells whose points bound the rest
        for some in (mine[:, :first], mine[:, first:]):
            cell, rows = some.ravel(), np.repeat(np.arange(len(q)), some.shape[1])
            by = np.argsort(cell, kind="stable")
            cell, rows = cell[by], rows[by]
            have, at = np.unique(cell, return_index=True)
            for c, lo, hi in zip(have, at, [*at[1:], len(cell)], strict=True):
                if self.start[c] < self.start[c + 1]:
                    near.add(rows[lo:hi], self.start[c], asked[rows[lo:hi]] @ self.table[self.start[c] : self.start[c + 1]].T)
            near.merge()
        return self._exactly(q, near)

    def settle(self, vectors: np.ndarray, k: int, beam: int, target: float) -> int | None:
        """The first of beam, 2 * beam, ... cells whose recall of the sample's k + 1 nearest points reaches the target, counted by distance so that ties count alike; None: search exactly, as without a sample."""
        if len(vectors) == 0:
            return None
        far = np.concatenate([self.exact(vectors[lo : lo + 256], k)[1][:, -1] for lo in range(0, len(vectors), 256)])
        wanted = min(k + 1, len(self.table))
        while beam < len(self.cells):
            hits = 0
            for lo in range(0, len(vectors), 1024):
                dist = self.search(vectors[lo : lo + 1024], k, beam)[1]
                hits += int((dist <= far[lo : lo + 1024, None] * (1 + 1e-5) + 1e-6).sum())
            if hits >= target * wanted * len(vectors):
                return beam
            beam *= 2
        return None

    def nearest(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, beam: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, squared distance): at least the k nearest other ids found of each query; of one vector's ids the least. Every point is compared without a beam, with one of over a third of the cells, and in small shards."""
        out, step = [], max(1, min(1024, (1 << 22) // (k + 1) // self.table.shape[1]))
        listed = beam is not None and 3 * beam <= len(self.cells) and len(self.table) > SMALL
        for lo in range(0, len(query_ids), step):
            ids, dist = self.search(vectors[lo : lo + step], k, beam) if listed else self.exact(vectors[lo : lo + step], k)
            r, c = np.nonzero(ids >= 0)
            node = ids[r, c]
            size = np.minimum(self.first[node + 1] - self.first[node], k + 1)
            at = np.repeat(self.first[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r, d = np.repeat(r, size), np.repeat(dist[r, c], size)
            found = self.ids[at]
            other = found != query_ids[lo + r]
            out.append((query_ids[lo + r[other]], found[other], d[other]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(role, dimension, ids, vectors) of the usable rows of (role, id, vector)."""
    role, ids, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
    size = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten().fill_null(float("nan")), np.float32)
    first = np.cumsum(size) - size
    for r in np.unique(role):
        for d in np.unique(size[(role == r) & (size > 0)]):
            rows = np.flatnonzero((role == r) & (size == d))
            v = flat[first[rows][:, None] + np.arange(d)]
            fine = np.isfinite(v).all(axis=1)
            if fine.any():
                yield int(r), int(d), ids[rows[fine]], v[fine]


def _searcher(k: int, beam: int, target: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (role, id, vector) of one shard sorted by role and id: role 0 its own, 1 the audit queries, 2 the other queries."""
        held: dict[tuple[int, int], list] = {}
        shards: dict[int, tuple[Shard, int | None]] = {}
        last: dict[tuple[int, int], int] = {}

        def ready(d: int) -> Iterator[pa.RecordBatch]:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop((0, d)), strict=True))
            shard = Shard(ids, vectors)
            asked, sample = (np.concatenate(x) for x in zip(*held.pop((1, d), [(ids[:0], vectors[:0])]), strict=True))
            shards[d] = shard, shard.settle(sample, k, beam, target)
            yield answer(d, asked, sample)

        def answer(d: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            q, n, dist = shards[d][0].nearest(ids, v, k, shards[d][1])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(np.sqrt(dist).astype(np.float32))], names=["query_id", "neighbor_id", "distance"])

        for batch in batches:
            for role, d, ids, v in _split(batch):
                new = np.ones(len(ids), bool)  # rows of one id count once; they are neighbours here
                new[1:] = ids[1:] != ids[:-1]
                if last.get((role, d)) == int(ids[0]):
                    new[0] = False
                last[role, d] = int(ids[-1])
                ids, v = ids[new], v[new]
                if role < 2:
                    held.setdefault((role, d), []).append((ids, v))
                    continue
                if (0, d) in held:
                    yield from ready(d)
                if d in shards:
                    yield answer(d, ids, v)
        for role, d in list(held):
            if role == 0:
                yield from ready(d)

    return search


def nearest_neighbors(vectors: DataFrame, k: int = 10, beam: int = 64, shards: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 1_000_000, asks: Column | None = None, audit: int = 300, target: float = 0.95) -> DataFrame:
    """query_id, neighbor_id, rank (1 .. k), distance (Euclidean) for every vector that asks, a condition on the rows of vectors (by default all ask).

    A vector's own id is no neighbour of it. Ties are ordered by neighbor_id. Rows
    that repeat an id count once, with the least vector. Rows with a null id, a null
    or empty vector or a value that isn't finite neither ask nor answer; vectors
    are compared only with those of the same dimension. Fewer than k others give
    fewer rows. Other columns are ignored. There are at least six shards, and one
    more for each further shard_rows vectors; every query is sent to each. About
    audit queries are answered exactly in each shard; a query is searched in `beam`
    cells, doubled until their recall is target, and beyond a third of the cells in
    all of them.
    """
    asking = F.coalesce(asks, F.lit(False)) if asks is not None else F.lit(True)
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), asking.alias("asks")).where("id is not null and v is not null")
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).first()
    n = shards or max(6, -(-size["n"] // shard_rows))
    sampled = (F.shiftrightunsigned(F.xxhash64(F.lit(5), "id"), 11).cast("double") / F.lit(float(1 << 53))) < audit / max(size["asks"], 1)
    own = F.array(F.struct(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("role")))
    sent_to = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(s.alias("shard"), F.when(sampled, 1).otherwise(2).alias("role")))
    sent = usable.select(F.explode(F.when(F.col("asks"), F.concat(own, sent_to)).otherwise(own)).alias("s"), "id", "v").select("s.shard", "s.role", "id", "v")
    placed = sent.repartitionById(n, F.col("shard")).sortWithinPartitions("role", "id", "v").select("role", "id", "v")
    found = placed.mapInArrow(_searcher(k, beam, target), RESULT)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "b")).select("query_id", F.col("b.neighbor_id").alias("neighbor_id"), (F.col("p") + 1).alias("rank"), F.col("b.distance").alias("distance"))
