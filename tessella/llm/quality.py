"""Quality selection by importance resampling.

Two generative models of hashed unigrams and bigrams are counted, one over the
target text and one over the whole corpus. A document's log weight is the log
likelihood ratio of its n-grams; Gumbel noise from a hash of the document is
added, and the top k keys are a sample without replacement in proportion to
the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec as tv
from tessella.llm.storage import write_table

BUCKETS = 10_000


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all unigrams and bigrams; tokens are runs of letters and digits or of punctuation, in lower case."""
    buf, off = tv.buffers(tv.padded_lower(texts))
    starts, ends, rows = tv.tokens(buf, tv.BYTE_CLASS[buf], off)
    h = tv.span_hashes(buf, starts, ends)
    pair = tv.mix(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    both = rows[:-1] == rows[1:]
    n = np.uint64(BUCKETS)
    return np.concatenate([(h % n).astype(np.int64), (pair[both] % n).astype(np.int64)]), np.concatenate([rows, rows[:-1][both]])


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, is_target) to one row (bucket, raw, target) per bucket and partition."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, flags = tv.as_array(batch.column(0)), np.asarray(batch.column(1))
        for start, end in tv.row_chunks(texts):
            bucket, rows = feature_buckets(texts.slice(start, end - start))
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[flags[start:end][rows]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, max_target: int = 20_000) -> np.ndarray:
    """Log ratio of target to raw probability for every bucket.

    The raw model counts every document. The target model counts the documents
    labelled quality = 1, at most max_target of them (the lowest hashes of
    doc_id): only those ids are broadcast, so the size of the broadcast is
    bounded by the parameter. Counts are smoothed by one half. Rows with a null
    doc_id are never target; without target rows all ratios are 0.
    """
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("target_id")).distinct().orderBy(F.xxhash64("target_id"), "target_id").limit(max_target)
    marked = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).join(F.broadcast(ids), F.col("d") == F.col("target_id"), "left").select("t", F.col("target_id").isNotNull().alias("is_target"))
    counts = marked.mapInArrow(count_features, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if target.sum() == 0:
        return np.zeros(BUCKETS)
    return np.log((target + 0.5) / (target.sum() + BUCKETS / 2)) - np.log((raw + 0.5) / (raw.sum() + BUCKETS / 2))


def log_weight(ratios: np.ndarray, text: Column | str) -> Column:
    """The log importance weight of the whole text; 0 for null and empty texts."""

    def score(column: pa.Array) -> pa.Array:
        texts = tv.as_array(column)
        out = np.zeros(len(texts))
        for start, end in tv.row_chunks(texts):
            bucket, rows = feature_buckets(texts.slice(start, end - start))
            out[start:end] = np.bincount(rows, weights=ratios[bucket], minlength=end - start)
        return pa.array(out)

    return F.arrow_udf(score, "double")(text)


def gumbel(seed: int, *keys: Column) -> Column:
    """Standard Gumbel noise from a hash of the keys."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, width: int = 4096, few: int = 50_000) -> float | None:
    """The exact k-th largest key, by histograms of ever narrower ranges; no sort of the table."""
    if k <= 0:
        return None
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n == 0:
        return None
    if k >= n:
        return lo
    left = k
    while True:
        inside = df.where(F.col(key).between(lo, hi))
        if n <= few or not (hi - lo) / width > 0:
            keys = inside.groupBy(key).count().orderBy(F.desc(key)).collect() if n > few else [(x[0], 1) for x in inside.select(key).collect()]
            for value, c in sorted(keys, reverse=True):
                left -= c
                if left <= 0:
                    return value
        bucket = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit((hi - lo) / width)), F.lit(width - 1))
        rows = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if left <= r["c"]:
                lo, hi, n = r["lo"], r["hi"], r["c"]
                break
            left -= r["c"]
        if lo == hi:
            return lo


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 1, max_target: int = 20_000) -> DataFrame:
    """Every document with doc_id, log_weight, gumbel_key and whether it is selected.

    fraction of the documents are selected; by default the share of labelled
    documents with quality = 1 (all if nothing is labelled). Documents whose keys
    tie at the border are all selected. The noise hangs on doc_id and text:
    repeated rows share a key. Null and empty texts have weight 0, null ids are
    allowed, other columns are ignored.
    """
    if fraction is None:
        good = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        fraction = 1.0 if good is None else good
    ratios = fit(docs, labels, max_target)
    scored = docs.select(F.col("doc_id"), log_weight(ratios, "text").alias("log_weight"), gumbel(seed, F.col("doc_id"), F.col("text")).alias("g"))
    scored = write_table(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("g")).alias("gumbel_key")), "resample")
    bar = kth_largest(scored, "gumbel_key", round(fraction * scored.count()))
    return scored.withColumn("selected", F.lit(False) if bar is None else F.col("gumbel_key") >= F.lit(bar))
