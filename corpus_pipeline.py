"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage is a function of (spark, docs, sf_dir) and works on all documents
that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, langid, linededup, mixing, neardup
from tessella.llm.storage import write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the bitmask filters know.

    So rows with null or empty text go. Labels may be null; repeated rows go or
    stay together; an empty table gives an empty one, here and in every stage.
    """
    return langid.keep_identified(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out, and documents of which nothing else remains.

    The first occurrence by (doc_id, text hash, position) stays, null ids first.
    Fully repeated rows count as one document and stay; null text stays.
    """
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates.

    That is the one with the least (doc_id, text hash), null ids last; of fully
    repeated rows one. Texts without words are alone and stay.
    """
    return neardup.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget.

    Null and empty texts hold none, and null items are in none; repeated rows of
    either table play no part.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by a Poisson draw toward their source's target weight, in random order; adds copy and shuffle_key.

    A null source is a source of its own, null text has no mass; fully repeated
    rows are drawn alike.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Language scores, near-duplicate graphs and edit matching have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each result is a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
