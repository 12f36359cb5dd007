"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the stage before kept, written as Parquet and read again, and
returns them with their own columns; the last returns the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm.decontaminate import find_leaks
from stayrate.llm.line_dedup import dedup_units
from stayrate.llm.ngram_join import jaccard_components
from stayrate.llm.packing import pack_batches
from stayrate.llm.quality import with_quality
from stayrate.llm.shared import fresh, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near duplicates share this percentage of their shingles of so many words; op3's own query has others.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go.

    Rows are judged one by one, so rows that repeat an id, or have none, stay or go each.
    """
    mark = fresh("quality", docs.columns)
    return with_quality(docs, mark).filter(f"`{mark}`.kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows without id stay.

    Documents link at a Jaccard similarity of ``NEAR_PERCENT`` / 100 of their ``NEAR_WORDS``-word shingles.
    Of rows that repeat an id the one with the smallest SHA-256 of its text stays.
    """
    groups = jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1")
    repeated = written(repeated.select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64("*"))
    one = (
        kept.join(repeated, "doc_id", "left_semi")
        .select("doc_id", row, order.alias("place"))
        .groupBy("doc_id")
        .agg(F.min_by("row", "place").alias("row"))
        .select("row.*")
    )
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those left without words go."""
    mark = fresh("removal", docs.columns)
    cleaned = dedup_units(docs, to=mark).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(F.col(f"`{mark}`.n_removed") > 0, F.length("text").cast(kind))
        cleaned = cleaned.withColumn("n_chars", F.coalesce(size, "n_chars"))
    return cleaned.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay, they hold none.

    Rows are judged one by one, so rows that repeat an id, or have none, stay or go each.
    """
    mark = fresh("hits", docs.columns)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark, to=mark).filter(F.size(f"`{mark}`") == 0).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each row; a text without words is in no batch and keeps its row."""
    return pack_batches(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Exact edit distances and the length optimisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
