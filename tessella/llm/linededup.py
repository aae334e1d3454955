"""Line de-duplication that returns keep bitmaps instead of text.

Hashes of all non-blank lines are sorted by hash, document and position within
each input partition, where all but the first occurrence of a line are known to
be later ones already. Only first ones go on to the range partition of their
hash (the hash is uniform, so equal ranges need no sampling pass), are sorted
alike and streamed once, so that a line in half of all documents comes in as
one row for each input partition. Known later ones are spread evenly past that.
Hashes, ids and positions are shuffled here, never text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import BROADCAST_BYTES, join_measured, write_table

_TRIM = " \t\r"
_LINES = "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, pos int, n_lines int"
_ORDER = ("h1", "h2", "doc_id", "text_hash", "pos")
_LATER = "doc_id bigint, text_hash bigint, n_lines int, pos int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted _LINES, and which rows repeat the line of an earlier document or position.

    A row without a hash repeats nothing.
    """
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        h1, h2, doc, text, pos = (batch.column(i) for i in (0, 1, 2, 3, 4))
        real = np.asarray(h1.is_valid())
        ids = np.asarray(doc.fill_null(0)), np.asarray(doc.is_valid()), np.asarray(text), np.asarray(pos.fill_null(-1))
        a, b = np.asarray(h1.fill_null(0)), np.asarray(h2.fill_null(0))
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (real[1:] != real[:-1])
        if last is not None:
            new[0] = (int(a[0]), int(b[0]), bool(real[0])) != last[0]
        # The place of the first occurrence in each run, carried over batch borders.
        head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        for_run = [x[np.maximum(head, 0)] for x in ids]
        if last is not None and not new[0]:
            lead = head < 0
            for x, v in zip(for_run, last[1], strict=True):
                x[lead] = v
        same = np.ones(n, bool)
        for x, y in zip(for_run, ids, strict=True):
            same &= x == y
        last = ((int(a[-1]), int(b[-1]), bool(real[-1])), [x[-1] for x in for_run])
        yield batch, real & ~same


def _mark_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that an input partition has before lose their hashes and keep their position."""
    for batch, later in _runs(batches):
        keep = pa.array(~later)
        none = pa.nulls(batch.num_rows, pa.int64())
        columns = [pc.if_else(keep, batch.column(i), none) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, *[batch.column(i) for i in range(2, 6)]], names=["h1", "h2", "doc_id", "text_hash", "pos", "n_lines"])


def _flag_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos becomes null for lines that stay; the sort order puts first occurrences first."""
    for batch, later in _runs(batches):
        pos = batch.column(4)
        goes = later | (np.asarray(batch.column(0).is_null()) & np.asarray(pos.is_valid()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(3), batch.column(5), pa.array(np.asarray(pos.fill_null(-1)), pa.int32(), mask=~goes)],
            names=["doc_id", "text_hash", "n_lines", "pos"],
        )


def _run_lengths(dropped: pa.Array, n_lines: pa.Array) -> pa.Array:
    out = [str(n) for n in np.asarray(n_lines)]
    lengths = np.asarray(dropped.value_lengths().fill_null(0))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.asarray(dropped.flatten())
    for i in np.flatnonzero(lengths):
        n = int(out[i])
        bits = np.ones(n, np.int8)
        bits[flat[offsets[i] : offsets[i + 1]]] = 0
        edges = np.flatnonzero(np.diff(bits)) + 1
        runs = np.diff(np.concatenate([[0], edges, [n]])).tolist()
        out[i] = ",".join(map(str, runs if bits[0] else [0, *runs]))
    return pa.array(out, pa.string())


def local_firsts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_LINES of all non-blank lines, without hashes where the input partition has the line before; a row without a position for documents of blank lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("ls"))
    indexed = F.filter(F.transform("ls", lambda l, i: F.struct(i.cast("int").alias("pos"), F.btrim(l, F.lit(_TRIM)).alias("line"))), lambda s: s["line"] != "")
    lines = docs.select("doc_id", "text_hash", F.size("ls").alias("n_lines"), F.explode_outer(indexed).alias("l")).select(
        F.when(F.col("l").isNotNull(), F.xxhash64("l.line")).alias("h1"),
        F.when(F.col("l").isNotNull(), F.xxhash64(F.lit(7), "l.line")).alias("h2"),
        "doc_id", "text_hash", F.col("l.pos").alias("pos"), "n_lines",
    )
    return lines.select(*_ORDER, "n_lines").sortWithinPartitions(*_ORDER).mapInArrow(_mark_local, _LINES)


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines, n_kept, keep_runs.

    keep_runs is the keep bitmap over the lines of the text (split at newlines),
    compressed as run lengths: kept, dropped, kept, ... ; it begins with 0 where
    the first line is dropped. Lines are compared without leading and trailing
    blanks; the first occurrence in the order (doc_id, text_hash, position) stays
    and so does every blank line.

    Null text counts as empty (one blank line, kept). A null doc_id is an id of
    its own and sorts first. Fully repeated rows are one document: one bitmap that
    holds for each of them. Rows that share an id and differ in text are separate
    documents, told apart by text_hash. Other columns are ignored. An empty table
    gives an empty result.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = local_firsts(df, id_col, text_col)
    # Equal ranges of the signed 64-bit hash: its top 31 bits, scaled to 0 .. parts - 1.
    place = F.coalesce(F.shiftright(((F.shiftright("h1", 33) + F.lit(1 << 30)) * F.lit(parts)), 31), F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(parts)))
    flagged = local.repartitionById(parts, place.cast("int")).sortWithinPartitions(*_ORDER).mapInArrow(_flag_later, _LATER)
    runs = F.arrow_udf(_run_lengths, "string")
    return (
        flagged.groupBy("doc_id", "text_hash")
        .agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
        .select("doc_id", "text_hash", "n_lines", (F.col("n_lines") - F.size("gone")).alias("n_kept"), runs("gone", "n_lines").alias("keep_runs"))
    )


def apply_bitmaps(text: Column | str, keep_runs: Column | str) -> Column:
    """The text without the lines that its bitmap drops; a null bitmap keeps all, a null text stays null."""
    text, keep_runs = (F.col(x) if isinstance(x, str) else x for x in (text, keep_runs))
    runs = F.split(keep_runs, ",").cast("array<int>")
    ends = F.aggregate(runs, F.array().cast("array<int>"), lambda s, n: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + n)))
    spans = F.filter(F.transform(F.arrays_zip(runs.alias("n"), ends.alias("e")), lambda r, i: F.struct(i.alias("i"), (r["e"] - r["n"] + 1).alias("start"), r["n"].alias("n"))), lambda r: (r["i"] % 2 == 0) & (r["n"] > 0))
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.flatten(F.transform(spans, lambda r: F.slice(lines, r["start"], r["n"]))), "\n")
    return F.when(keep_runs.isNull(), text).otherwise(kept)


def dedup_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with repeated lines taken out and the documents that only repeated others gone.

    A document goes when lines of it were dropped and none that remains has
    content. All columns and their order stay; n_chars, where there is one,
    follows the text. Nulls and repeated rows: see keep_bitmaps; a row with null
    text stays as it is. The bitmaps of documents that lose lines are written and
    measured: up to broadcast_bytes they are broadcast and text is not shuffled,
    beyond it documents are shuffled once.
    """
    maps = write_table(keep_bitmaps(docs).where("n_kept < n_lines").select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), "keep_runs"), "bitmaps")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("k1")) & (F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("k2"))
    joined = join_measured(left, maps, on, "left", F.length("keep_runs") + 64, broadcast_bytes)
    new = joined.select("row", "keep_runs", apply_bitmaps(F.col("row.text"), F.col("keep_runs")).alias("new_text"))
    new = new.where(F.col("keep_runs").isNull() | F.col("new_text").rlike(r"[^ \t\r\n]"))
    swap = {"text": F.col("new_text"), "n_chars": F.when(F.col("keep_runs").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text").cast("bigint")) if "n_chars" in docs.columns else None}
    return new.select(*[swap[c].alias(c) if c in swap else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
