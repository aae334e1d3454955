"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter per n-gram order holds all languages at once: a slot
is a bitmask of languages, inserting an n-gram of language l sets bit l in k
slots, and the AND of an n-gram's k slots gives every language that contains
it. Per document the masks are counted; the popcount of each language is
corrected for that language's false-positive rate, and the corrected shares
decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import textvec as tv
from tessella.llm.storage import write_table

ORDERS = (3, 5)
#: A filter has at least 2 ** LEAST_BITS slots, and more where its fullest language would set over SHARE of them.
LEAST_BITS, SHARE = 19, 0.16
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
UNDETERMINED = "und"
RESULT = "language string, rate double, margin double, n_grams bigint, scores array<double>"


@dataclass(frozen=True)
class LanguageModel:
    """languages; for each order the filter as planes of 8 languages (planes, slots) and its slots as a power of two; for each order the false-positive rates."""

    languages: tuple[str, ...]
    planes: tuple[np.ndarray, ...]
    bits: tuple[int, ...]
    false_rates: np.ndarray
    min_rate: float


def grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram as an integer, row) of all byte n-grams that lie within a row."""
    if len(buf) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(buf) - n + 1
    g = buf[:size].astype(np.uint64)
    for j in range(1, n):
        g |= buf[j : j + size].astype(np.uint64) << np.uint64(8 * j)
    lengths = np.diff(off)
    within = np.ones(len(buf), bool)
    for j in range(1, n):  # windows that would run over the row's end
        at = off[1:] - j
        within[at[(lengths >= j)]] = False
    within = within[:size]
    rows = np.repeat(np.arange(len(lengths)), lengths)[:size]
    return g[within], rows[within]


def slots(g: np.ndarray, bits: int = LEAST_BITS) -> list[np.ndarray]:
    return [((g * s) >> np.uint64(64 - bits)).astype(np.int64) for s in _SEEDS]


def build(languages: list[str], found: dict[tuple[int, int], np.ndarray], min_rate: float) -> LanguageModel:
    """A model from found[(language index, order)] = n-grams."""
    n_planes = max(1, -(-len(languages) // 8))
    planes, sizes, rates = [], [], np.zeros((len(ORDERS), len(languages)))
    for k, n in enumerate(ORDERS):
        most = max((len(g) for (_, o), g in found.items() if o == n), default=0)
        bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, most * len(_SEEDS) / SHARE)))))
        plane = np.zeros((n_planes, 1 << bits), np.uint8)
        for l in range(len(languages)):
            bit = np.uint8(1 << (l % 8))
            for s in slots(found.get((l, n), np.zeros(0, np.uint64)), bits):
                plane[l // 8][s] |= bit
            fill = np.count_nonzero(plane[l // 8] & bit) / (1 << bits)
            rates[k, l] = fill ** len(_SEEDS)
        planes.append(plane)
        sizes.append(bits)
    return LanguageModel(tuple(languages), tuple(planes), tuple(sizes), rates, min_rate)


def count_training_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n, gram, c), summed within a batch."""
    for batch in batches:
        langs, texts = batch.column(0), tv.as_array(batch.column(1))
        values = np.asarray(langs)
        for start, end in tv.row_chunks(texts):
            buf, off = tv.normalised(texts.slice(start, end - start), tv.LETTERS)
            for n in ORDERS:
                g, rows = grams(buf, off, n)
                lang = values[start:end][rows]
                for l in np.unique(lang):
                    u, c = np.unique(g[lang == l], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), l), pa.int32()), pa.array(np.full(len(u), n), pa.int32()), pa.array(u.view(np.int64)), pa.array(c)], names=["lang", "n", "gram", "c"])


def _level(doc_id: str) -> Column:
    """0 .. 63: the binary length of a 63-bit hash; half of all ids have 63, a quarter 62, and so on."""
    return F.length(F.bin(F.shiftrightunsigned(F.xxhash64(F.lit(11), doc_id), 1)))


def label_levels(docs: DataFrame, docs_per_language: int) -> DataFrame:
    """(lang, upto): for each label the least level below which lie at least docs_per_language labelled documents, 64 where there are fewer.

    The rows at each level are counted, with map-side combining, so a label with
    any number of documents keeps a sample of between docs_per_language and about
    twice as many, and never an empty one.
    """
    counts = docs.where("lang is not null and text is not null").groupBy("lang", _level("doc_id").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("level"))  # over at most 64 rows a label
    reached = counts.withColumn("below", below).where(F.col("below") >= docs_per_language).groupBy("lang").agg(F.min("level").alias("upto"))
    return counts.select("lang").distinct().join(reached, "lang", "left").select("lang", F.coalesce("upto", F.lit(64)).alias("upto"))


def sample(docs: DataFrame, levels: DataFrame, docs_per_language: int) -> DataFrame:
    """(lang, text) of docs_per_language documents of each label, those with the least hash of doc_id, ties broken by text; all where there are fewer."""
    l = levels.select(F.col("lang").alias("l_lang"), "upto")
    d = docs.select(F.col("lang").alias("d_lang"), F.col("text").alias("t"), F.xxhash64(F.lit(11), "doc_id").alias("h"), _level("doc_id").alias("level"))
    near = d.where("t is not null").join(l, (F.col("d_lang") == F.col("l_lang")) & (F.col("level") <= F.col("upto")))
    first = Window.partitionBy("d_lang").orderBy(F.shiftrightunsigned("h", 1), "t")
    return near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= docs_per_language).select("d_lang", "t")


def train(docs: DataFrame, docs_per_language: int = 500, min_count: int = 3, min_rate: float = 0.35) -> LanguageModel:
    """A model from documents labelled in column lang.

    It is fitted on docs_per_language documents of each label (see sample), and
    keeps every n-gram of them that occurs at least min_count times. Every label
    is a language, however rare: a language takes 64 KB of an order's filter, or
    more where n-grams are many. Rows with a null label or text are not used.
    Without any labelled row the model has no language and rejects everything.
    """
    levels = write_table(label_levels(docs, docs_per_language), "labels")
    names = sorted(r["lang"] for r in levels.select("lang").collect())
    if not names:
        return build([], {}, min_rate)
    index = docs.sparkSession.createDataFrame(list(enumerate(names)), "l int, l_name string")  # a local relation: Spark broadcasts it if it is small
    rows = sample(docs, levels, docs_per_language).join(index, F.col("d_lang") == F.col("l_name")).select("l", "t")
    counted = rows.mapInArrow(count_training_grams, "lang int, n int, gram bigint, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
    packed = counted.groupBy("lang", "n").agg(F.collect_list("gram").alias("g"))  # of the bounded sample
    found = {(r["lang"], r["n"]): np.array(r["g"], np.int64).view(np.uint64) for r in packed.toLocalIterator()}
    return build(names, found, min_rate)


def scores(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(corrected share of n-grams per row and language, n-grams per row)."""
    n_rows, n_lang = len(texts), len(model.languages)
    hits, total = np.zeros((n_rows, n_lang)), np.zeros(n_rows, np.int64)
    bits = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
    for start, end in tv.row_chunks(texts):
        buf, off = tv.normalised(texts.slice(start, end - start), tv.LETTERS)
        for k, n in enumerate(ORDERS):
            g, rows = grams(buf, off, n)
            at = slots(g, model.bits[k])
            count = np.bincount(rows, minlength=end - start)
            total[start:end] += count
            for p, plane in enumerate(model.planes[k]):
                mask = plane[at[0]]
                for s in at[1:]:
                    mask &= plane[s]
                table = np.bincount(rows * 256 + mask, minlength=(end - start) * 256).reshape(-1, 256)
                mine = slice(p * 8, min(n_lang, p * 8 + 8))
                rate = model.false_rates[k, mine]
                seen = (table @ bits)[:, : len(rate)]
                hits[start:end, mine] += np.maximum(0, (seen - count[:, None] * rate) / (1 - rate))
    return hits / np.maximum(total, 1)[:, None], total


def identifier(model: LanguageModel) -> Callable[[pa.Array], pa.Array]:
    def identify(column: pa.Array) -> pa.Array:
        share, total = scores(model, tv.as_array(column))
        n = len(total)
        if model.languages:
            best = share.argmax(axis=1)
            rate = share[np.arange(n), best]
            second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(n)
        else:
            best, rate, second = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        names = np.array([*model.languages, UNDETERMINED], object)
        name = names[np.where((total > 0) & (rate >= model.min_rate) & bool(model.languages), best, len(names) - 1)]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * share.shape[1], pa.int32()), pa.array(share.ravel()))
        return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(rate), pa.array(rate - second), pa.array(total), flat], names=["language", "rate", "margin", "n_grams", "scores"])

    return identify


def identify(model: LanguageModel, text: Column | str) -> Column:
    """A struct of RESULT for the whole text.

    language is the one with the greatest corrected share of n-grams (ties: the
    first by name), or "und" where that share is under model.min_rate or the text
    has no letters, so null and empty texts are "und". Each row is judged by
    itself: other columns, repeated rows and null ids play no part.
    """
    return F.arrow_udf(identifier(model), RESULT)(text)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs without those whose language is undetermined; all columns stay.

    Rows with null or empty text are undetermined and go; repeated rows stay or go
    together; an empty table gives an empty one.
    """
    return docs.where(identify(model, "text").getField("language") != UNDETERMINED)
