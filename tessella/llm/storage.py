"""Intermediate tables (see tessella.storage) and joins by their measured sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.storage import checkpoint_dir, cut, write_table  # noqa: F401

#: Up to so many bytes the small side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def join_measured(big: DataFrame, small: DataFrame, on: Column, how: str, row_bytes: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """big joined with a written table small, which is broadcast if its row_bytes sum up to `most` at most; beyond that both sides are shuffled.

    Either way gives the same rows.
    """
    size = small.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= most else small, on, how)


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, how: str = "inner", hot: int = 1 << 20) -> DataFrame:
    """left joined with a written table right that has one row a key and in size the number of left's rows with it.

    Keys with more than `hot` rows are split: left's rows of such a key go to
    ceil(size / hot) pieces by a hash of the row, and right's row to each of them.
    There are at most (left's rows / hot) such keys, and only they are broadcast.
    """
    pieces = right.where(F.col(size) > hot).select(F.col(key).alias("_key"), F.ceil(F.col(size) / hot).cast("int").alias("_pieces"))
    if pieces.isEmpty():
        return left.join(right, key, how)
    spread = left.join(F.broadcast(pieces), F.col(key) == F.col("_key"), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_pieces")).cast("int"), F.lit(0))).drop("_key", "_pieces")
    each = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(size) / hot).cast("int"), F.lit(1)) - 1)))
    return spread.join(each, [key, "_piece"], how).drop("_piece")
