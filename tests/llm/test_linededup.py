from __future__ import annotations

import random

import pytest

from tessella.llm import linededup
from tests.llm import data


def brute(rows):
    """Keep bitmaps of (doc_id, text): a set of seen lines over the documents in order."""
    docs = sorted({(i is not None, i or 0, h, t or "") for i, t, h in rows})
    seen, out = set(), {}
    for valid, i, h, text in docs:
        bits = []
        for line in text.split("\n"):
            key = line.strip(" \t\r")
            bits.append(not key or key not in seen)
            seen.add(key)
        runs, at, now = [], 0, True
        while at < len(bits):
            n = 0
            while at < len(bits) and bits[at] == now:
                n, at = n + 1, at + 1
            runs.append(n)
            now = not now
        out[i if valid else None, h] = (len(bits), sum(bits), ",".join(map(str, runs)))
    return out


def run(spark, rows, **options):
    from pyspark.sql import functions as F

    df = data.documents(spark, [(i, t, "en", "s") for i, t in rows])
    hashed = [(r["doc_id"], r["text"], r["h"]) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    got = linededup.keep_bitmaps(data.with_clashes(df), **options).collect()
    assert len(got) == len({(r["doc_id"], r["text_hash"]) for r in got})
    return {(r["doc_id"], r["text_hash"]): (r["n_lines"], r["n_kept"], r["keep_runs"]) for r in got}, brute(hashed)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_random_lines(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(["a", "b ", " b", "", "\tc", "d\r", f"own {rng.randint(0, 90)}"]) for _ in range(rng.randint(0, 30)))) for _ in range(120)]
    got, want = run(spark, rows, partitions=partitions)
    assert got == want


def test_one_line_in_more_rows_than_an_arrow_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, want = run(spark, [(i, f"same\nown {i}\nsame\nsame") for i in range(100)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in data.awkward_rows()]
    got, want = run(spark, rows)
    assert got == want


def test_a_hot_line_reaches_its_range_once_an_input_partition(spark):
    rows = [(i, f"boilerplate\nown {i}" if i % 2 else f"own {i}") for i in range(2000)]
    df = data.documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(5)
    sent = linededup.local_firsts(df)
    hot = linededup.F.xxhash64(linededup.F.lit("boilerplate"))
    assert sent.where(linededup.F.col("h1") == hot).count() == 5
    assert sent.count() == 3000


def test_bitmaps_apply_like_a_loop(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        lines = [rng.choice(["", "a", "b c", "é"]) for _ in range(rng.randint(1, 12))]
        bits = [rng.random() < 0.5 for _ in lines]
        runs, now = [0], True
        for bit in bits:
            if bit != now:
                runs.append(0)
                now = bit
            runs[-1] += 1
        rows.append(("\n".join(lines), ",".join(map(str, runs)), "\n".join(x for x, bit in zip(lines, bits, strict=True) if bit)))
    rows += [("a\nb", None, "a\nb"), (None, None, None)]
    got = spark.createDataFrame(rows, "t string, r string, want string").select("want", linededup.apply_bitmaps("t", "r").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_broadcast_and_shuffled_bitmaps_give_the_same(spark, most):
    docs = data.documents(spark, [(i if i % 7 else None, f"own {i % 90}\nfooter\nline {i % 5}", "en", "s") for i in range(200)])
    got = sorted(map(str, linededup.dedup_lines(docs, broadcast_bytes=most).collect()))
    assert got == sorted(map(str, linededup.dedup_lines(docs).collect())) and len(got) < 200


def test_dedup_takes_effect(spark):
    docs = data.with_clashes(data.documents(spark, [(1, "keep me\nfooter", "en", "s"), (2, "mine\nfooter\n", "en", "s"), (3, "footer", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, "twin\nrow", "en", "s"), (6, "twin\nrow", "en", "s")]))
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None)
    assert rows == [(1, "keep me\nfooter", 14), (2, "mine\n", 5), (5, "", 0), (6, "twin\nrow", 8), (6, "twin\nrow", 8)]
    assert out.where("doc_id = 4 and text is null").count() == 1
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
