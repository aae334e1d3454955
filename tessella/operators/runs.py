"""Maximal repeated runs of statements.

An island is a maximal common run of two blocks. For an anchor and a length L the
partners whose island reaches L form a set; a set is kept at the lengths where
it changes.

No pairs of places are made. Places with one run of L statements are a class,
found by hashes of L statements, made of two hashes of shorter runs that cover
them: first for lengths that double, then for all
lengths from each of those that repeats up to the next. An island begins where
the statements before differ, so the sets of a class follow from its counts by
the statement before and after; only classes that make a set collect their
places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(block: Column, pos: Column) -> Column:
    return F.struct(block.alias("block"), pos.alias("pos"))


def _segments(statements: DataFrame, least: int, group: str) -> DataFrame:
    """g, block, seg, items: runs of statements at consecutive positions with (pos, h, size, sum: of the sizes so far) in order; a block lies in one row or few."""
    s = statements.select(F.col(group).alias("g"), F.col("block_id").alias("block"), F.col("pos"), F.col("hash").alias("h"), F.col("norm_len").alias("size")).where("h is not null")
    in_block = Window.partitionBy("g", "block").orderBy("pos")
    s = s.withColumn("seg", F.col("pos") - F.row_number().over(in_block)).withColumn("sum", F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("g", "block", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "size", "sum"))).alias("items")).where(F.size("items") >= least)


def _top(least: int) -> Column:
    """The number of times that `least` doubles within a segment."""
    return F.length(F.bin(F.floor(F.size("items") / F.lit(least)))) - 1


def _levels(least: int) -> Column:
    """For each doubled length two hashes of the run at each place, made of those of its halves: no run is read statement by statement."""
    h = lambda i, k: F.get(F.col("items"), i + k)["h"]
    first = F.transform(F.sequence(F.lit(0), F.size("items") - least), lambda i: F.struct(F.xxhash64(*[h(i, k) for k in range(least)]).alias("a"), F.xxhash64(F.lit(7), *[h(i, k) for k in range(least)]).alias("b")))

    def double(acc: Column, j: Column) -> Column:
        last, m = F.get(acc, j - 1), F.lit(least) * F.pow(F.lit(2.0), j - 1).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size("items") - 2 * m), lambda i: F.struct(*_both(F.get(last, i), F.get(last, i + m), "a", "b")))

    none = F.array().cast("array<array<struct<a:bigint,b:bigint>>>")
    return F.aggregate(F.sequence(F.lit(0), _top(least)), none, lambda acc, j: F.concat(acc, F.array(F.when(j == 0, first).otherwise(double(acc, j)))))


def _both(left: Column, right: Column, a: str, b: str) -> tuple[Column, Column]:
    return F.xxhash64(left["a"], right["a"]).alias(a), F.xxhash64(F.lit(7), left["b"], right["b"]).alias(b)


def maximal_runs(statements: DataFrame, least: int = 3, least_chars: int = 128, group: str = "group_id") -> DataFrame:
    """(group, length, participants): sets of places that repeat a run, sorted by (block, pos).

    A set that is a strict subset of another of the same length is dropped, and so
    is one whose run has fewer than least_chars normalised characters. statements
    also has norm_len. Equal hashes mean equal statements, so their lengths agree.
    """
    segments, key = _segments(statements, least, group), ["g", "length", "k1", "k2"]
    heads = F.flatten(F.transform("levels", lambda level, j: F.transform(level, lambda x, i: F.struct(i.alias("i"), j.alias("j"), x["a"].alias("k1"), x["b"].alias("k2")))))
    heads = segments.select("g", "block", "seg", _levels(least).alias("levels")).select("g", "block", "seg", F.explode(heads).alias("r")).select("g", "block", "seg", "r.*")
    again = heads.groupBy("g", "j", "k1", "k2").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").drop("c")
    repeated = heads.join(again, ["g", "j", "k1", "k2"], "left_semi").groupBy("g", "block", "seg").agg(F.collect_list(F.struct("i", "j")).alias("found"))

    def row(i: Column, n: Column, m: Column, level: Column) -> Column:
        at = lambda j: F.get(F.col("items"), j)["h"]
        first = F.get(F.col("items"), i)
        chars = F.get(F.col("items"), i + n - 1)["sum"] - first["sum"] + first["size"]
        return F.struct(n.alias("length"), *_both(F.get(level, i), F.get(level, i + n - m), "k1", "k2"), first["pos"].alias("pos"), at(i - 1).alias("before"), at(i + n).alias("after"), chars.alias("chars"))

    def grown(f: Column) -> Column:
        """Runs of all lengths from a doubled one, m, up to the next; two runs of m statements cover each."""
        m = F.lit(least) * F.pow(F.lit(2.0), f["j"]).cast("int")
        return F.transform(F.sequence(m, F.least(2 * m - 1, F.size("items") - f["i"])), lambda n: row(f["i"], n, m, F.get(F.col("levels"), f["j"])))

    rows = segments.join(repeated, ["g", "block", "seg"]).select("g", "block", "items", "found", _levels(least).alias("levels")).select("g", "block", F.explode(F.flatten(F.transform("found", grown))).alias("r")).select("g", "block", "r.*")
    # Classes by the statement before each place: hot ones are counted map-side.
    sides = rows.groupBy(*key, "before").agg(F.count(F.lit(1)).alias("c"), F.min("after").alias("lo"), F.max("after").alias("hi"), F.count_if(F.col("after").isNull()).alias("ends"), F.min("chars").alias("chars"))
    classes = sides.groupBy(*key).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_before"), F.bool_or(F.col("before").isNull()).alias("starts"), F.bool_or(F.col("before").isNull() | (F.col("c") == 1)).alias("whole"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("ends").alias("ends"), F.min("chars").alias("chars")
    )
    # Not one that repeats only as part of a longer run to its left, or to its right.
    kept = classes.where("n >= 2 and (n_before > 1 or starts) and (ends > 0 or lo <> hi)").where(F.col("chars") >= least_chars).select(*key, "whole")
    members = rows.join(kept, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(place(F.col("block"), F.col("pos")).alias("p"), "before", "after"))).alias("m"), F.first("whole").alias("whole"))
    # A place whose statement before is its own, or that begins a block, meets all others: the set is the class, and holds every other.
    whole = members.where("whole").select("g", "length", F.transform("m", lambda x: x["p"]).alias("participants"))
    each = members.where("not whole").select("g", "length", "m", F.explode("m").alias("a")).withColumn("others", F.filter("m", lambda x: x["before"] != F.col("a.before")))
    longer = F.size(F.filter("others", lambda x: F.coalesce(x["after"] == F.col("a.after"), F.lit(False))))
    each = each.where((F.size("others") > 0) & (longer != F.size("others"))).select("g", "length", F.array_sort(F.concat(F.array("a.p"), F.transform("others", lambda x: x["p"]))).alias("participants")).distinct()
    return whole.unionByName(each).select(F.col("g").alias(group), "length", "participants")
