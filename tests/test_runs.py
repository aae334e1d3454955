"""Maximal runs against a slow version, on random blocks."""

from __future__ import annotations

import random

import pytest

from tessella.operators.runs import maximal_runs


def brute(rows, least=3, least_chars=20):
    """rows: {block: [(hash, size)]}."""
    places = [(b, i) for b, items in rows.items() for i in range(len(items))]
    reach = {}
    for b, i in places:
        for c, j in places:
            if (b, i) == (c, j):
                continue
            if i and j and rows[b][i - 1][0] == rows[c][j - 1][0]:
                continue  # not the beginning of the island
            n = 0
            while i + n < len(rows[b]) and j + n < len(rows[c]) and rows[b][i + n][0] == rows[c][j + n][0]:
                n += 1
            if n >= least:
                reach.setdefault((b, i), {})[c, j] = n
    found = set()
    for anchor, partners in reach.items():
        sets = {n: frozenset([anchor, *[p for p, m in partners.items() if m >= n]]) for n in range(least, max(partners.values()) + 1)}
        for n, s in sets.items():
            if n + 1 not in sets or len(sets[n + 1]) != len(s):
                found.add((n, s))
    kept = {(n, s) for n, s in found if not any(n == m and s < t for m, t in found)}
    out = set()
    for n, s in kept:
        b, i = min(s)
        if sum(size for _, size in rows[b][i : i + n]) >= least_chars:
            out.add((n, tuple(sorted(s))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_blocks(spark, seed):
    rng = random.Random(seed)
    rows = {b: [(rng.choice("ab" if seed > 3 else "abcde") if seed % 2 else f"s{rng.randint(0, 7)}", 0) for _ in range(rng.randint(2, 14))] for b in range(8)}
    rows[8] = rows[0] + rows[1]
    rows = {b: [(h, 3 + ord(h[-1]) % 5) for h, _ in items] for b, items in rows.items()}
    df = spark.createDataFrame([("g", b, i, h, n) for b, items in rows.items() for i, (h, n) in enumerate(items)], "group_id string, block_id int, pos int, hash string, norm_len int")
    got = {(r["length"], tuple((p["block"], p["pos"]) for p in r["participants"])) for r in maximal_runs(df.repartition(5), least_chars=20).collect()}
    assert got == brute(rows)


def test_groups_never_mix_and_empty_input(spark):
    schema = "group_id string, block_id int, pos int, hash string, norm_len int"
    rows = [(g, b, i, f"h{i}", 100) for g, b in (("x", 1), ("y", 2)) for i in range(5)]
    assert maximal_runs(spark.createDataFrame(rows, schema)).count() == 0
    assert maximal_runs(spark.createDataFrame([], schema)).count() == 0


def test_long_runs_and_a_hot_statement(spark):
    """Runs of many doublings, and one statement in every place: no pairs are made."""
    rows = {b: [(f"x{i}", 9) for i in range(70)] for b in (0, 1)} | {2: [("odd", 9)] + [(f"x{i}", 9) for i in range(20, 61)]} | {b: [("hot", 9), (f"own{b}", 9), ("hot", 9)] for b in range(3, 9)}
    df = spark.createDataFrame([("g", b, i, h, n) for b, items in rows.items() for i, (h, n) in enumerate(items)], "group_id string, block_id int, pos int, hash string, norm_len int")
    got = {(r["length"], tuple((p["block"], p["pos"]) for p in r["participants"])) for r in maximal_runs(df, least_chars=20).collect()}
    assert got == brute(rows) and (70, ((0, 0), (1, 0))) in got
    hot = spark.createDataFrame([("g", b, i, ["hot", f"s{b}", "end"][i], 50) for b in range(3000) for i in range(3)], "group_id string, block_id int, pos int, hash string, norm_len int")
    assert maximal_runs(hot).count() == 0
