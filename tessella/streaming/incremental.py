"""Incremental scans: only files whose fingerprint changed are read again.

A snapshot holds one fingerprint and the raw facts of every file. A changed or
new file is an anti join; its facts replace the old ones, and facts of files that
are gone are dropped. Cross-file rules then run over all facts, old and new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.extract.facts import raw_facts
from tessella.functions.text import hash_text


def fingerprints(files: DataFrame) -> DataFrame:
    """(group_id, file, size, content_hash); the group belongs to it, so a moved configuration counts as a change."""
    return files.select("group_id", "file", F.length("source").cast("bigint").alias("size"), hash_text(F.col("source")).alias("content_hash"))


def changed(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The files that the snapshot (fingerprints) doesn't have as they are."""
    now = files.withColumn("content_hash", hash_text(F.col("source")))
    return now.join(snapshot.select("group_id", "file", "content_hash"), ["group_id", "file", "content_hash"], "left_anti").select(*files.columns)


def cache_key(version: str, severities: dict[str, str], options: dict) -> str:
    """What besides the files decides a result: a snapshot under another key is a miss."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([version, sorted(severities.items()), sorted(options.items())], default=str).encode()).hexdigest()[:16]


def refresh(spark: SparkSession, files: DataFrame, path: str, key: str, needs: list[str] | None = None) -> tuple[DataFrame, int]:
    """(raw facts of all files, number of files read again), with the snapshot below path brought up to date.

    Versions of the snapshot are folders path/key-n; the newest complete one
    counts, and a run that dies leaves the one before in place.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName().rsplit("-", 1)[1]) for s in (fs.listStatus(hadoop) if fs.exists(hadoop) else []) if s.getPath().getName().startswith(f"{key}-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "prints/_SUCCESS")))
    if versions:
        old = f"{path}/{key}-{versions[-1]}"
        prints, facts = spark.read.parquet(f"{old}/prints"), spark.read.parquet(f"{old}/facts")
        todo = changed(files, prints)
        kept = facts.join(files.select("group_id", "file"), ["group_id", "file"], "left_semi").join(todo.select("group_id", "file"), ["group_id", "file"], "left_anti")
        fresh = raw_facts(todo, needs)
        n, same = todo.count(), prints.count() == files.count()
        if n == 0 and same:
            return facts, 0
        new = kept.select(*fresh.columns).unionByName(fresh)
    else:
        n, new = files.count(), raw_facts(files, needs)
    to = f"{path}/{key}-{(versions[-1] if versions else 0) + 1}"
    new.write.mode("overwrite").parquet(f"{to}/facts")
    fingerprints(files).write.mode("overwrite").parquet(f"{to}/prints")
    for v in versions[:-1]:  # the one before stays, for readers that have it open
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}-{v}"), True)
    return spark.read.parquet(f"{to}/facts"), n


def watch(stream: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None):
    """A streaming query that merges a stream of files (group_id, file, source) into a fingerprint table below path.

    Every micro-batch writes the files that are new or changed, the last version
    of a file in a batch counting, as one folder named by the batch: a batch that
    runs again overwrites its own folder.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.withColumn("_n", F.monotonically_increasing_id()).groupBy("group_id", "file").agg(F.max_by("source", "_n").alias("source"))
        try:
            seen = spark.read.parquet(f"{path}/batch=*").where(F.col("batch") < number)
            before = seen.groupBy("group_id", "file").agg(F.max_by("content_hash", "batch").alias("content_hash"))
            last = changed(last, before)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        out = fingerprints(last).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_change is not None:
            on_change(last, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
