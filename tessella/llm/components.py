"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.storage import cut


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of every node 0 .. n - 1, by label propagation with pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition, batch by batch, by stars with the same components."""
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(at[: len(a)], at[len(a) :], len(nodes))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that is connected; nodes without an edge don't appear.

    edges has bigint columns a and b. Edges of a node with itself are ignored.
    Each round is one large and one small star (a window over the edges by node,
    no join, nothing collected); the number of rounds grows with the logarithm of
    the longest path. Every round is checkpointed.
    """
    e = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a bigint, b bigint")
    e = cut(e.distinct())
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        stars = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        e = cut(stars.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
