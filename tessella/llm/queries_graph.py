"""Queries 3 and 10: searches over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, neardup


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates of every document."""
    return neardup.near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all vectors, of every vector whose id is divisible by 20."""
    return ann.nearest_neighbors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asks=F.col("vec_id") % 20 == 0)


QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours, "op3_simhash_near_dedup": op3_simhash_near_dedup}
