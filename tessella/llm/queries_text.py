"""Queries 1, 2, 4, 7 and 9: whole texts through models and matchers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, pii, quality, secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    found = docs.select("doc_id", langid.identify(model, "text").alias("r"))
    return found.select("doc_id", "r.language", "r.rate", "r.margin", "r.n_grams", (F.col("r.language") != langid.UNDETERMINED).alias("kept"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight against the good labelled ones, and the Gumbel top-k sample."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirmed secret in every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal datum in every document."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair within an error budget of a tenth of the item's length."""
    return decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_language_id": op1_language_id, "op2_importance_resampling": op2_importance_resampling, "op4_secret_scan": op4_secret_scan, "op7_pii_crf": op7_pii_crf, "op9_decontamination": op9_decontamination}
