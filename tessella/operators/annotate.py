"""Comments joined to diagnostics: annotations and suppressions, by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import clean_block_comment

KEYWORD = "@allow"


def comment_runs(comments: DataFrame) -> DataFrame:
    """The last comment that ends on each line, with what stands above a diagnostic on the next line.

    Returns file, line, kind, value, above (the text of the block comment, or of
    the unbroken run of line comments that ends there) and lines (its lines).
    """
    last = comments.withColumn("rn", F.row_number().over(Window.partitionBy("file", "end_line").orderBy(F.desc("end"), F.desc("start")))).where("rn = 1").select("file", F.col("end_line").alias("line"), "kind", "value", "start_line")
    w = Window.partitionBy("file").orderBy("line")
    broken = (F.col("kind") == "Block") | (F.lag("kind").over(w) != "Line") | (F.lag("line").over(w) != F.col("line") - 1) | F.lag("line").over(w).isNull()
    run = last.withColumn("run", F.sum(F.when(broken, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.collect_list(F.trim("value")).over(Window.partitionBy("file", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    out = run.withColumn("lines", F.when(F.col("kind") == "Block", F.split(clean_block_comment(F.col("value")), "\n")).otherwise(so_far))
    return out.select("file", "line", "kind", "value", "start_line", "lines", F.array_join("lines", "\n").alias("above"))


def is_directive(text, keyword: str = KEYWORD):
    return text.rlike(r"^(@ts-(ignore|expect-error|nocheck|check)|eslint-|biome-ignore|prettier-ignore|" + keyword + r")\b")


def suppress(diagnostics: DataFrame, comments: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """Drops diagnostics below error that a comment allows: `keyword rule-id` at the start of a comment's line.

    The comment ends on the diagnostic's line or the next, or stands right above
    (a block comment, or any line of an unbroken run of line comments).
    """
    runs = comment_runs(comments)
    pattern = "^" + keyword + r"\s+(\S*\w)"
    allowed = lambda ls: F.array_compact(F.transform(ls, lambda l: F.when(l.rlike(pattern), F.regexp_extract(l, pattern, 1))))
    single = comments.select("file", "end_line", F.when(F.col("kind") == "Block", F.split(clean_block_comment(F.col("value")), "\n")).otherwise(F.array(F.trim("value"))).alias("ls"))
    on = single.select("file", F.explode(F.array(F.col("end_line"), F.col("end_line") - 1)).alias("line"), F.explode(allowed(F.col("ls"))).alias("rule_id"))
    above = runs.select("file", (F.col("line") + 1).alias("line"), F.explode(allowed(F.col("lines"))).alias("rule_id"))
    keys = on.union(above).distinct().select(F.col("file").alias("k_file"), F.col("line").alias("k_line"), F.col("rule_id").alias("k_rule"))
    hit = (F.col("file") == F.col("k_file")) & (F.col("line") == F.col("k_line")) & (F.col("rule_id") == F.col("k_rule")) & (F.col("severity") != "error")
    return diagnostics.join(keys, hit, "left_anti")


def attach(diagnostics: DataFrame, comments: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """Sets annotation: the line comment on the diagnostic's own line unless it is a directive, else what stands right above."""
    runs = comment_runs(comments)
    own = runs.where("kind = 'Line'").where(~is_directive(F.trim("value"), keyword)).select(F.col("file").alias("f1"), F.col("line").alias("l1"), F.trim("value").alias("own"))
    above = runs.select(F.col("file").alias("f2"), (F.col("line") + 1).alias("l2"), "above")
    d = diagnostics.join(own, (F.col("file") == F.col("f1")) & (F.col("line") == F.col("l1")), "left").join(above, (F.col("file") == F.col("f2")) & (F.col("line") == F.col("l2")), "left")
    return d.withColumn("annotation", F.coalesce("own", "above", "annotation")).select(*diagnostics.columns)
