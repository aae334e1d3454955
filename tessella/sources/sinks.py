"""Report forms."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_text(rel_path: Column) -> Column:
    """path:line:col severity [rule] message"""
    return F.format_string("%s:%d:%d %s [%s] %s", rel_path, F.col("line"), F.col("col"), F.col("severity"), F.col("rule_id"), F.col("message"))


def json_rows(diagnostics: DataFrame) -> DataFrame:
    """One JSON object a row, with fixable."""
    return diagnostics.select(F.to_json(F.struct("rule_id", "severity", "message", "file", "line", "col", "annotation", F.col("fix").isNotNull().alias("fixable"))).alias("value"))


def summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id")


def json_report(visible: DataFrame, file_count: int, exit_code: int, fixed_count: int | None = None) -> str:
    """The whole report as one document; its rows are what a terminal would show, so they come to the driver."""
    rows = [json.loads(r["value"]) for r in json_rows(visible.orderBy("file", "line", "col", "rule_id")).toLocalIterator()]
    out = {"diagnostics": rows, "fileCount": file_count, "exitCode": exit_code}
    return json.dumps(out | ({} if fixed_count is None else {"fixedCount": fixed_count}), ensure_ascii=False, indent=2)


def grouped_text(visible: DataFrame, width: int = 100) -> str:
    """Blocks by file with wrapped messages."""
    out, last = [], None
    for r in visible.orderBy("file", "line", "col", "rule_id").toLocalIterator():
        if r["file"] != last:
            out += ([""] if out else []) + [r["file"]]
            last = r["file"]
        head = f"  {r['line']}:{r['col']}  {r['severity']}  "
        out += textwrap.wrap(f"{r['message']}  [{r['rule_id']}]", width, initial_indent=head, subsequent_indent=" " * len(head))
        if r["annotation"]:
            out += [f"{' ' * len(head)}note: {line}" for line in r["annotation"].split("\n")]
    return "\n".join(out)


def write_flat(diagnostics: DataFrame, path: str, rel_path: Column) -> None:
    diagnostics.select(flat_text(rel_path).alias("value")).write.mode("overwrite").text(path)
