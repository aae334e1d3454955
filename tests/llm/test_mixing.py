from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm import mixing
from tests.llm import data


def test_rates_reach_the_weights(spark):
    docs = data.documents(spark, [(i, "x" * (10 if i % 3 else 40), "en", ["a", "b", "c"][i % 3]) for i in range(300)])
    r = {x["source"]: x for x in mixing.rates(docs, {"a": 1.0, "b": 3.0}).collect()}
    total = sum(x["mass"] for x in r.values())
    assert r["c"]["rate"] == 0 and abs(r["a"]["rate"] * r["a"]["mass"] / total - 0.25) < 1e-9 and abs(r["b"]["rate"] * r["b"]["mass"] / total - 0.75) < 1e-9


def test_counts_invert_the_poisson_distribution(spark):
    docs = data.documents(spark, [(i, f"text {i}", "en", f"s{i % 4}") for i in range(4000)])
    lam = {"s0": 0.3, "s1": 1.0, "s2": 4.5, "s3": 0.0}
    rates = spark.createDataFrame(list(lam.items()), "source string, rate double")
    out = mixing.replicate(docs, rates)
    n = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform("mix-1", F.col("doc_id"), F.md5("text")).alias("u")).collect()}
    for i in range(4000):
        rate, k, p = lam[f"s{i % 4}"], 0, math.exp(-lam[f"s{i % 4}"])
        c = p
        while c <= u[i]:
            k += 1
            p *= rate / k
            c += p
        assert n[i] == k
    for s in range(4):
        got = sum(n[i] for i in range(s, 4000, 4)) / 1000
        assert abs(got - lam[f"s{s}"]) < 0.25
    again = mixing.replicate(docs.repartition(7), rates)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_large_rates_are_reached(spark):
    """A rate of 5,000 and one of 900,000: the draws invert the distribution function, summed exactly here, and their means hold."""
    docs = data.documents(spark, [(i, f"text {i}", "en", "s") for i in range(40)])
    rates = spark.createDataFrame([("s", 5000.0)], "source string, rate double")
    n = Counter(r["doc_id"] for r in mixing.replicate(docs, rates).select("doc_id").collect())
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform("mix-1", F.col("doc_id"), F.md5("text")).alias("u")).collect()}
    steps = [math.exp(k * math.log(5000) - 5000 - math.lgamma(k + 1)) for k in range(6000)]
    for i in range(40):
        k, c = 0, steps[0]
        while c <= u[i]:
            k += 1
            c += steps[k]
        assert n[i] == k
    assert abs(sum(n.values()) / 40 - 5000) < 5 * math.sqrt(5000 / 40)
    first, c = mixing.cdf(900_000.0)
    mean = first + sum(1 - x for x in c)
    assert abs(mean - 900_000) < 1e-3 and len(c) < 25_000


def test_a_small_source_reaches_its_share(spark):
    docs = data.documents(spark, [(0, "x" * 20, "en", "tiny")] + [(i, "y" * 1000, "en", "big") for i in range(1, 400)])
    out = mixing.mix(docs, {"tiny": 0.5, "big": 0.5}).groupBy("source").agg(F.sum(F.length("text")).alias("m")).collect()
    m = {r["source"]: r["m"] for r in out}
    assert abs(m["tiny"] / sum(m.values()) - 0.5) < 0.05  # a rate of about 9,975


def test_order_is_random(spark):
    docs = data.documents(spark, [(i, f"t {i}", "en", "s") for i in range(2000)])
    ids = [r["doc_id"] for r in mixing.mix(docs, epochs=2.0).collect()]
    ups = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.4 < ups < 0.6


def test_awkward_rows(spark):
    rows = data.awkward_rows()
    docs = data.with_clashes(data.documents(spark, rows))
    out = mixing.mix(docs, epochs=3.0)
    assert out.columns == [*[c for c in docs.columns if c != "copy"], "copy", "shuffle_key"]
    twins = Counter(r["copy"] for r in out.where("doc_id = 9").collect())
    assert all(v == 2 for v in twins.values())  # fully repeated rows are drawn alike
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = data.documents(spark, [(1, None, "en", None), (2, "", "en", "b")])
    assert mixing.mix(blank).where("doc_id > 2").count() == 0


def test_the_join_beyond_the_broadcast_limit_gives_the_same(spark):
    docs = data.documents(spark, [(i, f"text {i}", "en", None if i % 5 == 0 else f"s{i % 4}") for i in range(400)])
    rates = mixing.rates(docs, epochs=2.0)
    small, large = mixing.replicate(docs, rates), mixing.replicate(docs, rates, broadcast_bytes=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
