from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessella.llm import quality
from tests.llm import data


def _labelled(spark, n=240):
    rows = [(i, data.prose("en" if i % 2 else "de", 60, i), "x", "s") for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n // 2)], "doc_id bigint, quality int, toxic int")
    return data.documents(spark, rows), labels, rows


def test_ratios_equal_a_slow_count(spark):
    docs, labels, rows = _labelled(spark, 40)
    import pyarrow as pa

    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, text, *_ in rows:
        buckets = quality.feature_buckets(quality.tv.as_array(pa.array([text])))[0]
        for b in buckets:
            raw[b] += 1
            target[b] += i < 20 and i % 2
    want = np.log((target + 0.5) / (target.sum() + quality.BUCKETS / 2)) - np.log((raw + 0.5) / (raw.sum() + quality.BUCKETS / 2))
    got = quality.fit(docs, labels)
    assert np.allclose(got, want)
    text = rows[3][1]
    words = text.lower().split()
    assert len(quality.feature_buckets(quality.tv.as_array(pa.array([text])))[0]) == 2 * len(words) - 1


def test_good_held_out_documents_weigh_more(spark):
    docs, labels, _ = _labelled(spark)
    out = {r["doc_id"]: r for r in quality.resample(docs, labels).collect()}
    held = range(120, 240)
    auc = np.mean([out[a]["log_weight"] > out[b]["log_weight"] for a in held if a % 2 for b in held if not b % 2])
    assert auc > 0.99
    assert sum(r["selected"] for r in out.values()) == 120


@pytest.mark.parametrize("k", [0, 1, 7, 500, 4999, 5000, 9000])
def test_kth_largest_is_exact(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 1e6 * rng.random()]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = None if k == 0 else sorted(values, reverse=True)[min(k, 5000) - 1]
    assert quality.kth_largest(df, "x", k, width=16, few=100) == want


def test_gumbel_noise_is_uniform(spark):
    df = spark.range(20000).select(quality.gumbel(1, quality.F.col("id")).alias("g"))
    got = sorted(r["g"] for r in df.collect())
    for q in (0.1, 0.5, 0.9):
        assert abs(got[int(q * 20000)] + math.log(-math.log(q))) < 0.06


def test_awkward_rows(spark):
    docs = data.with_clashes(data.documents(spark, data.awkward_rows()))
    labels = data.with_clashes(spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (999, 1, 0)], "doc_id bigint, quality int, toxic int"))
    out = quality.resample(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r["log_weight"] == 0 for r in out if r["doc_id"] in (5, 6, 7))
    assert len({r["gumbel_key"] for r in out if r["doc_id"] == 9}) == 1
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).where("selected").count() == docs.count()
