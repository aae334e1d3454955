from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import neardup
from tessella.llm.components import components, roots
from tessella.llm.smallworld import BYTES, SmallWorld
from tests.llm import data


def _codes(rng, clusters: int, members: int, flips: int) -> np.ndarray:
    base = rng.integers(0, 256, (clusters, BYTES), dtype=np.uint8)
    out = []
    for row in base:
        for _ in range(members):
            bits = np.unpackbits(row)
            bits[rng.choice(256, rng.integers(0, flips), replace=False)] ^= 1
            out.append(np.packbits(bits))
    return np.unique(np.array(out), axis=0)


@pytest.mark.parametrize(("clusters", "members", "flips"), [(400, 4, 60), (20, 120, 50), (3, 600, 40)])
def test_graph_recall(clusters, members, flips):
    codes = _codes(np.random.default_rng(5), clusters, members, flips)
    g = SmallWorld(codes)
    exact = g.exact(codes, neardup.RADIUS)
    truth = set(zip(exact[0].tolist(), exact[1].tolist(), strict=True))
    got = g.within(codes, neardup.RADIUS, 16, 4, neardup.HORIZON)
    found = set(zip(got[0].tolist(), got[1].tolist(), strict=True))
    assert found <= truth
    assert len(found) >= 0.95 * len(truth)


def test_simhash_and_sketch_equal_a_slow_count():
    texts = ["a b c d a b", "", "one", "A, b; C!", None, "x y " * 400]
    h, rows = neardup.shingles(neardup.tv.as_array(pa.array(texts)))
    got, marks = neardup.simhashes(h, rows, len(texts)), neardup.sketches(h, rows, len(texts))
    for r in range(len(texts)):
        mine = h[rows == r]
        wide = np.stack([neardup.tv.mix(mine + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(4)], axis=1).view(np.uint8).reshape(len(mine), 32)
        votes = np.unpackbits(wide, axis=1).sum(axis=0) if len(mine) else np.zeros(256)
        assert (np.unpackbits(got[r]) == (2 * votes > len(mine))).all()
    assert neardup.similarity(marks[0], marks[0]) == 1
    assert neardup.similarity(marks[0], marks[5]) < 0.2


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_components_equal_union_find(spark, n):
    rng = random.Random(n)
    edges = [(rng.randint(-50, 300), rng.randint(-50, 300)) for _ in range(n)] + ([(i, i + 1) for i in range(1000, 1200)] if n > 50 else []) + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_roots():
    assert roots(np.array([4, 3, 1]), np.array([3, 2, 0]), 6).tolist() == [0, 0, 2, 2, 2, 5]


def _edit(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"w{rng.randint(0, 9999)}"
    return " ".join(w)


def test_planted_copies_and_clean_documents(spark):
    distinct = lambda n, seed: " ".join(f"w{random.Random(f'{seed}-{i}').randint(0, 40000)}" for i in range(n))
    rows, want = [], {}
    for g in range(40):
        text = distinct(120 + g, g)
        for k in range(1 + g % 4):
            i = g * 10 + k
            rows.append((i, text if k == 1 else _edit(text, 0.04 * (k > 0), i), "en", "s"))
            want[i] = g * 10
    got = neardup.near_duplicate_groups(data.documents(spark, rows).repartition(4)).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == want
    sizes = {g: list(want.values()).count(g) for g in want.values()}
    assert all(r["group_size"] == sizes[r["group_id"]] and r["is_representative"] == (r["doc_id"] == r["group_id"]) for r in got)


def _slow_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = (np.stack([m >> 4, m & 15], axis=1).ravel() for m in (a, b))
    used = ((x > 0) | (y > 0)).sum()
    return max(0.0, (((x == y) & (x > 0)).sum() / max(used, 1) - 1 / 15) / (1 - 1 / 15))


@pytest.mark.parametrize("shards", [1, 9])
def test_links_and_groups_against_every_pair(spark, shards):
    distinct = lambda n, seed: " ".join(f"w{random.Random(f'{seed}-{i}').randint(0, 40000)}" for i in range(n))
    texts = [_edit(distinct(80, g), 0.03 * k, g * 7 + k) for g in range(60) for k in range(5)] + [distinct(300, 999) + f" end {k}" for k in range(30)]
    docs = data.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    prints = neardup.fingerprints(docs).collect()
    node = {r["doc_id"]: r["node"] for r in prints}
    code = {r["node"]: np.frombuffer(bytes(r["code"]), np.uint8) for r in prints}
    mark = {r["node"]: np.frombuffer(bytes(r["sketch"]), np.uint8) for r in prints}
    names = sorted(code)
    truth = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if np.bitwise_count(code[a] ^ code[b]).sum() <= neardup.RADIUS and _slow_similarity(mark[a], mark[b]) >= 0.5:
                truth.add((a, b))
    table = spark.createDataFrame([(n, bytearray(code[n].tobytes()), bytearray(mark[n].tobytes())) for n in names], "node bigint, code binary, sketch binary")
    got = neardup.links(table, shards=shards).collect()
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got if r["link"]} <= truth
    index = {n: i for i, n in enumerate(names)}
    classes = lambda pairs: neardup.roots(np.array([index[a] for a, _ in pairs]), np.array([index[b] for _, b in pairs]), len(names)).tolist()
    want = classes(truth)
    assert classes([(r["a"], r["b"]) for r in got]) == want
    groups = neardup.near_duplicate_groups(docs, shards=shards).collect()
    first = {}
    for d in range(len(texts)):
        first.setdefault(want[index[node[d]]], d)
    assert {r["doc_id"]: r["group_id"] for r in groups} == {d: first[want[index[node[d]]]] for d in range(len(texts))}
    linked = {n for p in truth for n in p}
    assert all((r["n_links"] > 0) == (node[r["doc_id"]] in linked) for r in groups)


def _hot(n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """n fingerprints of one text with small edits."""
    base, mark = rng.integers(0, 256, BYTES, dtype=np.uint8), rng.integers(0, 256, neardup.MARK, dtype=np.uint8) | 0x11
    codes = base ^ np.packbits(rng.random((n, 256)) < 0.06, axis=1)
    return codes, np.where(rng.random((n, neardup.MARK)) < 0.15, rng.integers(0, 256, (n, neardup.MARK), dtype=np.uint8) | 0x11, mark)


def test_a_group_of_a_hundred_thousand_costs_no_square():
    rng = np.random.default_rng(4)
    codes, marks = _hot(100_000, rng)
    lone = rng.integers(0, 256, (5000, BYTES), dtype=np.uint8), rng.integers(0, 256, (5000, neardup.MARK), dtype=np.uint8) | 0x11
    shard = neardup.Shard(np.arange(105_000), np.concatenate([codes, lone[0]]), np.concatenate([marks, lone[1]]))
    assert len(np.unique(shard.label)) == 5001
    more, more_marks = _hot(100_000, np.random.default_rng(4))
    asked = [0]
    real = shard.graph.search
    shard.graph.search = lambda q, beam, *a, **k: (asked.__setitem__(0, asked[0] + len(q) * beam), real(q, beam, *a, **k))[1]
    q, label, place = shard.links(more[:3000], more_marks[:3000], np.full(3000, -1), (16, 4))
    assert len(q) == 3000 and len(set(label.tolist())) == 1 and sorted(q.tolist()) == list(range(3000))
    assert asked[0] <= 3000 * (16 + 32)  # one beam, and one doubling that finds nothing new
    own = shard.links(shard.graph.codes[:0], marks[:0], np.zeros(0, np.int64), (16, 4))
    assert len(own[0]) == 0


def test_one_code_with_many_sketches():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 256, BYTES, dtype=np.uint8)
    a, b = (rng.integers(0, 256, neardup.MARK, dtype=np.uint8) | 0x11 for _ in range(2))
    marks = np.stack([a] * 50 + [b] * 50)
    marks[:, 0] = rng.integers(0, 256, 100, dtype=np.uint8) | 0x11
    shard = neardup.Shard(np.arange(100), np.tile(code, (100, 1)), marks)
    assert len(np.unique(shard.label)) == 2
    q, label, _ = shard.links(np.stack([code, code]), np.stack([a, b]), np.full(2, -1), (16, 4))
    assert sorted(q.tolist()) == [0, 1] and len(set(label.tolist())) == 2


def test_hot_groups_and_texts_are_split_where_they_are_joined(spark):
    rows = [(i, "one text that very many documents share among them all", "en", "s") for i in range(300)] + [(1000 + i, f"own words {i} alone here {i * 7}", "en", "s") for i in range(40)]
    docs = data.documents(spark, rows)
    want = sorted(map(str, neardup.near_duplicate_groups(docs).drop("n_links").collect()))
    assert want == sorted(map(str, neardup.near_duplicate_groups(docs, hot=20).drop("n_links").collect()))
    assert sorted(r["doc_id"] for r in neardup.keep_representatives(docs, broadcast_bytes=0).collect()) == sorted(r["doc_id"] for r in neardup.keep_representatives(docs).collect())


def test_of_repeated_rows_the_least_stays(spark):
    rows = [(1, "some words that repeat here", lang, "s") for lang in ("fr", "de", "en", "de")] + [(2, "some words that repeat here", "aa", "s")]
    kept = neardup.keep_representatives(data.documents(spark, rows).repartition(3)).collect()
    assert [(r["doc_id"], r["lang"]) for r in kept] == [(1, "de")]


def test_awkward_rows(spark):
    rows = data.awkward_rows()
    docs = data.with_clashes(data.documents(spark, rows))
    got = neardup.near_duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    assert sum(r["is_representative"] for r in got if r["doc_id"] == 9) == 1
    kept = neardup.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13]
    assert ids.count(None) == 3  # texts without words are alone, fully repeated or not
    assert neardup.keep_representatives(docs.limit(0)).count() == 0
    assert neardup.near_duplicate_groups(docs.limit(0)).count() == 0


def test_audit_sees_small_groups_beside_a_hot_one():
    rng = np.random.default_rng(3)
    codes, marks = _hot(400, rng)
    lone, lone_marks = rng.integers(0, 256, (16_000, BYTES), dtype=np.uint8), rng.integers(0, 256, (16_000, neardup.MARK), dtype=np.uint8) | 0x11
    shard = neardup.Shard(np.arange(16_400), np.concatenate([lone, codes]), np.concatenate([lone_marks, marks]))
    alike = rng.uniform(0.5, 1, 400)  # pairs of texts of any similarity from the threshold on
    pairs = lone[:400] ^ np.packbits(rng.random((400, 256)) < np.arccos(2 * alike / (1 + alike))[:, None] / np.pi, axis=1)
    none = np.full(400, -1)
    recall = lambda search: len(shard.links(pairs, lone_marks[:400], none, search)[0]) / 400
    most = recall(None)
    assert most > 0.97 and recall((16, 4)) < 0.9 * most
    truth = shard.links(codes[:100], marks[:100], np.full(100, -1), None)
    assert len(shard.links(codes[:100], marks[:100], np.full(100, -1), (16, 4))[0]) == len(truth[0]) == 100  # the hot group alone would pass at once
    settings = shard.settle(codes[:100], marks[:100], np.full(100, -1), truth, 0.95)
    assert settings != (16, 4) and recall(settings) >= 0.93 * most
    nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
    assert shard.settle(codes[:0], marks[:0], none[:0], nothing, 0.95) != (16, 4)  # no links in the sample prove nothing


def test_a_larger_shard_needs_no_wider_search():
    """Pairs of any similarity among many lone texts: by orders of the codes alone their recall falls as the shard grows, and each query then compares thousands."""
    rng = np.random.default_rng(8)
    n = 60_000
    lone, marks = rng.integers(0, 256, (n, BYTES), dtype=np.uint8), rng.integers(1, 16, (n, 2 * neardup.MARK), dtype=np.uint8)
    alike = rng.uniform(0.5, 1, (400, 1))
    pairs = lone[:400] ^ np.packbits(rng.random((400, 256)) < np.arccos(2 * alike / (1 + alike)) / np.pi, axis=1)
    near = np.where(rng.random((400, 2 * neardup.MARK)) < alike, marks[:400], rng.integers(1, 16, (400, 2 * neardup.MARK), dtype=np.uint8))
    marks, near = (x[:, 0::2] << 4 | x[:, 1::2] for x in (marks, near))
    shard = neardup.Shard(np.arange(n), lone, marks)
    none = np.full(400, -1)
    most = len(shard.links(pairs, near, none, None)[0])
    nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
    settings = shard.settle(pairs[:0], near[:0], none[:0], nothing, 0.95)
    assert most > 250 and len(shard.links(pairs, near, none, settings)[0]) >= 0.95 * most
    assert 2 * settings[1] * BYTES <= 256


def _packed(values: np.ndarray) -> np.ndarray:
    return values[:, 0::2] << 4 | values[:, 1::2]


def test_short_texts_agree_in_buckets_as_often_as_they_are_similar():
    rng = np.random.default_rng(1)
    h, rows = [], []
    for pair in range(300):  # two of 9 words in 12 differ: a similarity of 9 / 15
        common = rng.integers(0, 1 << 62, 9)
        for k in range(2):
            h += [*common, *rng.integers(0, 1 << 62, 3)]
            rows += [2 * pair + k] * 12
    marks = neardup.sketches(np.array(h, np.uint64), np.array(rows), 600)
    got = neardup.buckets(marks)
    assert 0 <= got.min() and got.max() < 65_536
    same = got[0::2] == got[1::2]
    assert same.any(axis=1).mean() > 0.92 and 0.07 < same.mean() < 0.25  # 0.6 ** 4 = 0.13
    other = got[0::2] == np.roll(got[1::2], 1, axis=0)
    assert other.mean() < 0.002
    assert (neardup.buckets(marks[:0]).shape, neardup.buckets(np.zeros((1, neardup.MARK), np.uint8)).shape) == ((0, neardup.BANDS), (1, neardup.BANDS))


def test_entries_are_the_codes_of_equal_buckets_and_few_of_full_ones():
    rng = np.random.default_rng(2)
    values = rng.integers(1, 16, (500, 2 * neardup.MARK), dtype=np.uint8)
    values[:, 30:] = values[0, 30:]  # most buckets hold all texts
    marks, codes = _packed(values), rng.integers(0, 256, (500, BYTES), dtype=np.uint8)
    x = neardup.words(codes)
    index = neardup.Buckets(marks, np.arange(500))
    got = index.entries(marks[:20], x[:20], x, 500, 110, 500)
    d = np.bitwise_count(x[:20, None] ^ x[None]).sum(axis=2)
    for q in range(20):
        assert sorted(got[q][got[q] >= 0].tolist()) == np.flatnonzero(d[q] <= 110).tolist()
    few = index.entries(marks[:20], x[:20], x, 2, 256, 40)
    assert few.shape[1] <= 40 and all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in few)
    assert index.entries(marks[:20], x[:20], x, 500, -1, 40).shape == (20, 0)


def test_texts_of_few_pairs_find_all_their_partners_in_the_cheapest_search():
    """Remains of line de-duplication may be a few words long; such texts share few buckets, so no search may be needed to find their partners."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 5_000, (30_000, 5))
    edited = words[:1_500].copy()
    edited[:, 4] = rng.integers(5_000, 9_000, 1_500)  # 3 of 5 word pairs stay the same
    long = rng.integers(0, 5_000, (3_000, 40))
    texts = neardup.tv.as_array(pa.array([" ".join(f"w{w}" for w in t) for part in (words, long, edited) for t in part]))
    h, rows = neardup.shingles(texts)
    codes, marks = neardup.simhashes(h, rows, len(texts)), neardup.sketches(h, rows, len(texts))
    shard = neardup.Shard(np.arange(33_000), codes[:33_000], marks[:33_000])
    asked, none = slice(32_500, None), np.full(2_000, -1)  # some long ones among them
    exact = shard.links(codes[asked], marks[asked], none, None)
    found = shard.links(codes[asked], marks[asked], none, neardup.LADDER[0])
    small = exact[0] >= 500
    assert small.sum() > 1_200
    assert {*zip(*(x[small].tolist() for x in exact[:2]), strict=True)} <= {*zip(*(x.tolist() for x in found[:2]), strict=True)}
