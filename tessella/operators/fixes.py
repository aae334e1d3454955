"""Applying edits to files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splice(source: str, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """source with edits applied from the last to the first; one that reaches into an applied one is skipped. Offsets are UTF-16 units."""
    raw = source.encode("utf-16-le", "surrogatepass")
    edge, n = len(raw) // 2, 0
    for start, end, text in sorted(edits, key=lambda e: (-e[0], -e[1], e[2])):
        if 0 <= start <= end <= edge:
            raw = raw[: 2 * start] + text.encode("utf-16-le", "surrogatepass") + raw[2 * end :]
            edge, n = start, n + 1
    return raw.decode("utf-16-le", "surrogatepass"), n


def apply_fixes(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """file, source, applied for every file with edits. Each edit depends on the one before, so a file is one group of pandas rows."""
    edits = diagnostics.where("fix is not null").select("file", F.col("fix.start").alias("s"), F.col("fix.end").alias("e"), F.col("fix.text").alias("t")).distinct()
    listed = edits.groupBy("file").agg(F.collect_list(F.struct("s", "e", "t")).alias("edits"))
    both = files.select("file", "source").join(listed, "file")

    def run(batches):
        for pdf in batches:
            done = [splice(s, [(x["s"], x["e"], x["t"]) for x in e]) for s, e in zip(pdf["source"], pdf["edits"], strict=True)]
            yield pd.DataFrame({"file": pdf["file"], "source": [d[0] for d in done], "applied": [d[1] for d in done]})

    return both.mapInPandas(run, "file string, source string, applied int")
