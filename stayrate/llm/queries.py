"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm.decontaminate import find_leaks
from stayrate.llm.licenses import scan_licenses
from stayrate.llm.line_dedup import dedup_units
from stayrate.llm.ngram_join import jaccard_components
from stayrate.llm.oracle import oracle_sql as oracle_sql
from stayrate.llm.packing import pack_batches
from stayrate.llm.quality import repetition_quality
from stayrate.llm.resampling import resample
from stayrate.llm.shared import new_path, written
from stayrate.llm.suffix_dedup import remove_repeats
from stayrate.llm.token_files import read_files, token_files
from stayrate.llm.token_rollup import Rollup, deleted, inserted, revised, with_bpe, with_words
from stayrate.llm.url_filter import judge_urls
from stayrate.llm.warc import archived
from stayrate.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

# The rules (host, path, verdict) of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


BPE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "inline(hits)")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch, slot and padding of each document; those without words are in no batch."""
    return pack_batches(table(spark, sf_dir, "documents")).drop("lang", "source", "n_chars")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document; those without words are linked with nothing."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("representative")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page; a url that is null or without ``://`` is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of each document; a null or empty text has no words and fails."""
    return repetition_quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per notice found; documents without one, null and empty texts give no row."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, read back from the archives; null html is an empty payload."""
    return archived(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents.

    All texts are inserted by words, and by BPE with an estimate of a token for four bytes; the
    estimates are revised to the counts, and exact copies but the smallest id are deleted. One
    batch is committed twice.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    docs = docs.withColumn("estimate", F.expr("coalesce(octet_length(text), 0) div 4"))
    counted = written(with_bpe(with_words(docs, "words"), "bpe", BPE_RANKS), "rollup-counted")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # Written, so that the join deals both sides anew and Spark can split a hot digest.
    first = written(first.filter("n > 1"), "rollup-first")
    copies = counted.join(first, "digest").filter("doc_id > first")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("load-words", inserted(counted, "words/1", "words"))
    rollup.commit("load-bpe", inserted(counted, "byte_bpe_50k/1", "estimate"))
    exact = revised(counted, "byte_bpe_50k/1", "estimate", "bpe")
    rollup.commit("count-bpe", exact)
    gone = deleted(copies, "words/1", "words").union(deleted(copies, "byte_bpe_50k/1", "bpe"))
    rollup.commit("drop-copies", gone)
    rollup.commit("count-bpe", exact)
    return rollup.totals()


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of the rest of each document; null is empty."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated passages, and their offsets; null texts stay null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_units(docs).select("doc_id", "text", "removal.*")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files.

    Rows without id come first; a null or empty text holds the end id alone.
    """
    from public_tokenizers import path

    files = token_files(table(spark, sf_dir, "documents"), path(WORD_BPE), END_ID)
    return read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four whitened components of each finite vector; the fit list is all distinct vectors."""
    return whiten(table(spark, sf_dir, "embeddings"), most=4)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with weight and score; a quarter of those of 20 words, drawn, has a rank."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target, percent=25, min_words=20, seed=7).drop("n_words")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_benchmark_decontamination,
            op2_packing,
            op3_ngram_jaccard_join,
            op4_url_filters,
            op5_quality_rules,
            op6_license_scans,
            op7_warc,
            op8_token_counts,
            op9_suffix_dedup,
            op10_substring_dedup,
            op11_token_files,
            op12_embedding_whitening,
            op13_importance_resampling,
        )
    }

