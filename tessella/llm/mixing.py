"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k drawn from a Poisson distribution with its
source's mean repetition rate by inverting the distribution function at a
uniform number taken from a hash of the document, so the draw needs no state and
gives the same result on every retry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import join_measured, write_table

#: The distribution function is tabulated so many standard deviations, and TAIL_MORE, around the rate.
TAIL, TAIL_MORE = 12, 20


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the keys; SQL engines agree on it."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(df: DataFrame, weights: dict[str, float] | None = None, smoothing: float = 0.7, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: source, n_docs, mass (characters), weight, rate.

    weights are target shares of the output's characters (scaled to 1; a source
    that is not named gets 0). Without weights the target is mass ** smoothing.
    rate = epochs * weight * total mass / mass. A source without any text has
    rate epochs * weight * number of sources, 0 if unnamed.
    """
    per = df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")).alias("mass"))
    if weights is None:
        raw = F.pow(F.col("mass").cast("double"), F.lit(smoothing))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(raw)
    per = write_table(per.withColumn("raw", raw), "mix-sources")
    total = per.agg(F.sum("raw").alias("raw"), F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n")).first()
    weight = F.col("raw") / F.lit(total["raw"]) if total["raw"] else F.lit(0.0)
    each = F.when(F.col("mass") > 0, F.lit(float(total["mass"] or 0)) / F.col("mass")).otherwise(F.lit(float(total["n"])))
    return per.select("source", "n_docs", "mass", weight.alias("weight"), (F.lit(epochs) * weight * each).alias("rate"))


def cdf(rate: float) -> tuple[int, np.ndarray]:
    """(k0, the Poisson distribution function at k0, k0 + 1, ...): k0 lies so far under the rate that nothing of note is below it.

    Probabilities are taken relative to the first from sums of logarithms, so no
    rate is too large. The table has about 24 * sqrt(rate) places: for a large
    rate far fewer than the copies that a document gets.
    """
    if not rate > 0:
        return 0, np.ones(1)
    reach = TAIL * np.sqrt(rate) + TAIL_MORE
    first, last = max(0, int(np.floor(rate - reach))), int(np.ceil(rate + reach))
    logs = np.concatenate([[0.0], np.cumsum(np.log(rate) - np.log(np.arange(first + 1, last + 1)))])
    p = np.exp(logs - logs.max())
    return first, np.cumsum(p) / p.sum()


def _tables(rate: pa.Array) -> pa.Array:
    made = [cdf(float(r or 0.0)) for r in rate.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(c) for _, c in made])])
    flat = np.concatenate([c for _, c in made] or [np.zeros(0)])
    return pa.StructArray.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["first", "c"])


def replicate(df: DataFrame, source_rates: DataFrame, seed: str = "mix-1", partitions: int | None = None, carry: list[str] | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """df with every row repeated by its draw, shuffled globally; adds copy (1, 2, ...) and shuffle_key.

    The draw hangs on seed, doc_id and the MD5 of the text, so fully repeated
    rows get the same count, and so do rows that share a null id and a text. A
    null source is a source of its own. Null text counts as empty. Rows are
    spread over the partitions by a hash of their key and sorted by it there:
    within and across files the order is random, and the same on every run.
    carry names the columns to return (all of df by default); columns of df named
    copy or shuffle_key are replaced.

    The rates (one row and some hundred bytes a source) are written and measured
    first: up to broadcast_bytes they are broadcast, so documents are shuffled
    once, for their order. Beyond it they are joined on the source, where adaptive
    execution splits a hot one.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [c for c in (carry or df.columns) if c not in ("copy", "shuffle_key")]
    made = F.arrow_udf(_tables, "first int, c array<double>")("rate")  # one row a source
    tables = write_table(source_rates.select(F.col("source").alias("rate_source"), made.alias("m")).select("rate_source", "m.first", F.col("m.c").alias("cdf")), "mix-rates")
    row_bytes = F.size("cdf") * 8 + F.coalesce(F.length("rate_source"), F.lit(0)) * 4 + 64
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    digest = F.md5(F.coalesce(F.col("row.text"), F.lit("")))
    drawn = join_measured(whole, tables, F.col("row.source").cast("string").eqNullSafe(F.col("rate_source")), "inner", row_bytes, broadcast_bytes).select("row", digest.alias("digest"), "first", "cdf")
    u = uniform(seed, F.col("row.doc_id"), F.col("digest"))
    drawn = drawn.select("row", "digest", (F.col("first") + F.size(F.filter("cdf", lambda c: c <= u))).alias("n")).where("n > 0")
    copies = drawn.select("row", "digest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.select("row", "copy", F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "digest", "copy")).alias("shuffle_key"))
    out = keyed.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], "copy", "shuffle_key")
    return out.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


def mix(df: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", **options) -> DataFrame:
    """rates() of df, then replicate() with them."""
    return replicate(df, rates(df, weights, **options), seed)
