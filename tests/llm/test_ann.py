from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(ids, v, k):
    out = {}
    for i, q in zip(ids, v, strict=True):
        d = np.sqrt(((v - q) ** 2).sum(axis=1))
        order = sorted((float(x), j) for x, j in zip(d, ids, strict=True) if j != i)
        out[i] = order[:k]
    return out


@pytest.mark.parametrize(("n", "shards"), [(1500, 1), (1500, 4)])
def test_recall(spark, n, shards):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(20, 24))
    v = (centres[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], SCHEMA)
    got = {}
    for r in ann.nearest_neighbors(df, shards=shards).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    want = exact(list(range(n)), v.astype(np.float64), 10)
    hit = sum(len({x[1] for x in got[i]} & {j for _, j in want[i]}) for i in range(n))
    assert hit >= 0.9 * 10 * n
    for i in range(0, n, 97):
        assert [x[0] for x in sorted(got[i])] == list(range(1, 11))
        assert all(abs(d - float(np.linalg.norm(v[i] - v[j]))) < 1e-3 for _, j, d in got[i])


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, None]), (None, [0.0, 0.0]), (8, [5.0]), (9, [6.0]), (3, [1.0, 0.0]), (10, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "s", "shard", "role", "b", "p", "label")})
    got = sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 4)) for r in ann.nearest_neighbors(df).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (8, 1, 9, 1.0), (9, 1, 8, 1.0)]
    assert ann.nearest_neighbors(df.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [float(i // 40), 1.0]) for i in range(200)], SCHEMA)
    got = ann.nearest_neighbors(df, k=5).collect()
    assert len(got) == 1000 and all(r["distance"] == 0 for r in got)
    assert sorted(r["neighbor_id"] for r in got if r["query_id"] == 41) == [40, 42, 43, 44, 45]


def test_a_very_long_vector(spark):
    v = np.random.default_rng(0).normal(size=(30, 3000)).astype(np.float32)
    got = ann.nearest_neighbors(spark.createDataFrame([(i, v[i].tolist()) for i in range(30)], SCHEMA), k=3).collect()
    want = exact(list(range(30)), v.astype(np.float64), 3)
    assert all(r["neighbor_id"] in {j for _, j in want[r["query_id"]]} for r in got) and len(got) == 90


@pytest.mark.parametrize("shards", [1, 3])
def test_queries_against_brute_force(spark, shards):
    """Vectors without clusters, where a narrow beam fails: the audit widens it."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(3000)], SCHEMA)
    asks = ann.F.col("vec_id") % 20 == 0
    got = {}
    for r in ann.nearest_neighbors(df, shards=shards, beam=12, asks=asks).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbor_id"])
    assert set(got) == set(range(0, 3000, 20))
    want = exact(list(range(3000)), v.astype(np.float64), 10)
    assert sum(len(got[i] & {j for _, j in want[i]}) for i in got) >= 0.9 * 10 * len(got)


def test_the_beam_doubles_until_the_recall_is_reached():
    v = np.random.default_rng(2).normal(size=(2500, 64)).astype(np.float32)
    shard = ann.Shard(np.arange(2500), v)
    asks = np.random.default_rng(3).normal(size=(100, 64)).astype(np.float32)
    beam = shard.settle(asks, 10, 11, 0.95)
    assert beam > 11 and shard.settle(asks, 10, 11, 1.01) is None
    ids, dist = shard.exact(asks, 10)
    d = ((asks[:, None] - shard.points[None]) ** 2).sum(axis=2)
    assert (ids == np.argsort(d, axis=1)[:, :11]).mean() > 0.99 and np.allclose(dist, np.sort(d, axis=1)[:, :11], atol=1e-2)


def _asked(shard, asks, k=10):
    """What nearest() gives after settle(), as sets of ids by query, and how many distances it computes."""
    beam = shard.settle(asks[:200], k, 64, 0.95)
    seen, real = [0], ann.Nearest.add
    ann.Nearest.add = lambda self, rows, first, dist: (seen.__setitem__(0, seen[0] + dist.size), real(self, rows, first, dist))[1]
    try:
        q, ids, _ = shard.nearest(np.arange(len(asks)) + 1_000_000, asks, k, beam)
    finally:
        ann.Nearest.add = real
    return [set(ids[q == i + 1_000_000][:k].tolist()) for i in range(len(asks))], seen[0]


def _truth(v, asks, k=10):
    return [set(np.argsort(((v.astype(np.float64) - a) ** 2).sum(axis=1))[:k].tolist()) for a in asks.astype(np.float64)]


def test_vectors_without_clusters_are_compared_in_products():
    """A graph of these takes a widened beam for each query and an insertion for each vector; comparing with all costs less and misses nothing."""
    rng = np.random.default_rng(11)
    v, asks = rng.normal(size=(20_000, 64)).astype(np.float32), rng.normal(size=(300, 64)).astype(np.float32)
    got, seen = _asked(ann.Shard(np.arange(20_000), v), asks)
    assert got == _truth(v, asks) and seen == 20_000 * 300


def test_clustered_vectors_are_compared_in_few_cells():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(200, 32))
    draw = lambda n: (centres[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, 32))).astype(np.float32)
    v, asks = draw(20_000), draw(300)
    got, seen = _asked(ann.Shard(np.arange(20_000), v), asks)
    assert sum(len(a & b) for a, b in zip(got, _truth(v, asks), strict=True)) >= 0.95 * 10 * 300
    assert seen < 0.34 * 20_000 * 300


@pytest.mark.parametrize(("shift", "scale"), [(1000, 1), (0, 1e25)])
def test_vectors_far_from_the_origin_and_very_long_ones(shift, scale):
    rng = np.random.default_rng(13)
    v = ((rng.normal(size=(3000, 16)) * 0.5 + shift) * scale).astype(np.float32)
    shard = ann.Shard(np.arange(3000), v)
    for beam in (None, len(shard.cells)):
        q, ids, dist = shard.nearest(np.arange(50), v[:50], 5, beam)
        want = [set(np.argsort(((v.astype(np.float64) - a) ** 2).sum(axis=1))[1:6].tolist()) for a in v[:50].astype(np.float64)]
        assert sum(len(set(ids[q == i][:5].tolist()) & want[i]) for i in range(50)) >= 0.98 * 250 and np.isfinite(dist).all()


def test_more_ties_than_neighbours():
    v = np.eye(200, dtype=np.float32)
    shard = ann.Shard(np.arange(200), v)
    for found in (shard.exact(v, 7), shard.search(v, 7, len(shard.cells))):
        assert found[0].shape == (200, 8) and (found[0] >= 0).all()
        assert (found[1][:, 0] == 0).all() and np.allclose(found[1][:, 1:], 2)
        assert all(len(set(r.tolist())) == 8 for r in found[0])


def test_without_a_sample_all_are_compared():
    shard = ann.Shard(np.arange(100), np.random.default_rng(1).normal(size=(100, 8)).astype(np.float32))
    assert shard.settle(np.zeros((0, 8), np.float32), 10, 64, 0.95) is None
