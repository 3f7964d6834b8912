"""The driver's queries of this subpackage; each takes (spark, sf_dir) and applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, near_dup, packing, quality, substring_dedup, token_counts, toxicity, url_filter, winnowing
from .oracle import oracle_sql as oracle_sql
from .shared import tables


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score (six digits) of every page."""
    return url_filter.judge(tables(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence, language of the text alone and declared language of every page and document."""
    return language_id.identify(*tables(spark, sf_dir, "pages", "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the set of two-word shingles, component and whether it is the one kept, of every document."""
    return near_dup.near_duplicates(tables(spark, sf_dir, "documents"), words=2, percent=80)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed and the digest of what is kept, of every document."""
    return substring_dedup.deduplicate(tables(spark, sf_dir, "documents")).drop("tag", "kept_text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its digest and its place in a sequence."""
    return packing.pack(tables(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.scored(*tables(spark, sf_dir, "documents", "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return token_counts.counted(tables(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return winnowing.fingerprints(tables(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified pair of a document and a test item."""
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return decontamination.leaks(documents, benchmark)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scored(*tables(spark, sf_dir, "documents", "labels"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
