"""Groups of equal entries and the one entry that hosts a group's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(entries: DataFrame, keys: list[str], file: str = "file", line: str = "line", collation: str | None = "UNICODE", carry: list[str] | None = None, least: int = 2) -> DataFrame:
    """One row per group of at least `least` entries: keys, size, n_files and entries sorted by (file, line, rest).

    One shuffle on the keys. collation None sorts files by their bytes. Rows with
    a null key are no group.
    """
    order = F.col(file) if collation is None else F.collate(F.col(file), collation)
    rest = [c for c in (carry if carry is not None else entries.columns) if c not in (*keys, file, line)]
    entry = F.struct(order.alias("_order"), F.col(line).alias("_line"), F.col(file).alias("file"), F.col(line).alias("line"), *[F.col(c) for c in rest])
    alive = entries
    for k in keys:
        alive = alive.where(F.col(k).isNotNull())
    out = alive.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count(F.lit(1)).alias("size"), F.count_distinct(F.col(file)).alias("n_files"))
    return out.where(F.col("size") >= least)


def report_target(entries: Column, reportable: Column | None = None, prefer_copy: bool = True) -> Column:
    """0-based place of the entry that hosts the report, null if none may.

    With prefer_copy the first reportable entry after the first, else the first;
    without it the first reportable one. reportable is a function of an entry; by
    default every entry is.
    """
    may = reportable if reportable is not None else (lambda e: F.lit(True))
    places = F.filter(F.sequence(F.lit(0), F.size(entries) - 1), lambda i: may(F.element_at(entries, (i + 1).cast("int"))))
    if not prefer_copy:
        return F.get(places, F.lit(0))
    return F.when(F.size(entries) < 2, F.lit(None)).otherwise(F.coalesce(F.get(F.filter(places, lambda i: i > 0), F.lit(0)), F.get(places, F.lit(0))))


def others(entries: Column, place: Column, text) -> Column:
    """The other entries' texts, joined by a comma and a blank."""
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(i.alias("i"), text(e).alias("t"))), lambda s: s["i"] != place)
    return F.array_join(F.transform(kept, lambda s: s["t"]), ", ")


def diagnostics(rows: DataFrame, rule_id: str, severity: str, message: Column, file: Column | str = "file", line: Column | str = "line", col: Column | None = None, fix: Column | None = None) -> DataFrame:
    """rows as diagnostics."""
    from tessella.schema import FIX

    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), message.alias("message"), as_col(file).alias("file"), as_col(line).cast("int").alias("line"),
        F.coalesce(col if col is not None else F.lit(1), F.lit(1)).cast("int").alias("col"), F.lit(None).cast("string").alias("annotation"), (fix if fix is not None else F.lit(None)).cast(FIX).alias("fix"),
    )


def report_groups(groups: DataFrame, rule_id: str, severity: str, other_text, message, reportable=None, prefer_copy: bool = True) -> DataFrame:
    """One diagnostic per group, at its host; message(host, others) makes the text."""
    placed = groups.withColumn("_place", report_target(F.col("entries"), reportable, prefer_copy)).where("_place is not null")
    placed = placed.withColumn("_host", F.get("entries", F.col("_place"))).withColumn("_others", others(F.col("entries"), F.col("_place"), other_text))
    has_col = "col" in [f.name for f in groups.schema["entries"].dataType.elementType.fields]
    return diagnostics(placed, rule_id, severity, message(F.col("_host"), F.col("_others"), F.col("size")), F.col("_host.file"), F.col("_host.line"), F.col("_host.col") if has_col else None)
