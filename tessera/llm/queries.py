"""One query per operator, over its whole table with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, licenses, mixing, near_dedup, passages, pieces, pivots, toxicity, warc, weak_quality
from .tables import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = pieces.MODEL) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(model_path), check=True)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_features(avi.with_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_license_scan finds of the base phrases, which SQL can say too."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage, and a row of its own for each passage's first holder."""
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    held = found.groupBy("other_doc_id", "other_start", "other_end").agg(F.count(F.lit(1)).alias("copies"))
    mine = held.select(
        F.col("other_doc_id").alias("doc_id"), F.col("other_start").alias("start_word"), F.col("other_end").alias("end_word"), "other_doc_id", "other_start", "other_end",
        F.lit(1.0).alias("similarity"), F.lit(True).alias("kept"),
    )
    return found.withColumn("kept", F.lit(False)).unionByName(mine)


def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.linked_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_warc_salvage, op3_toxicity, op4_weak_quality, op5_mix_sources, op6_avi_media, op7_license_scan, license_base, op8_minhash_near_dedup, op9_substring_dedup, op10_pivot_index)
}

ORACLE_SQL: dict[str, str] = {
    "op8_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op2_warc_salvage": warc.ORACLE_SQL,
    "license_base": licenses.BASE_SQL,
    "op5_mix_sources": mixing.oracle_sql(),
    "op10_pivot_index": pivots.ORACLE_SQL,
}
