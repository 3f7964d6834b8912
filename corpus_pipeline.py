"""A corpus, cleaned and packed: quality, near duplicates, repeated passages, benchmark leaks, sequences.

What every stage makes of unusual rows: a null text counts as an empty one where it is judged and is passed on as null; rows
with a null id are judged like others, but are never near duplicates; equal rows are judged alike, so all of them stay or
all go, but for near duplicates, where ids decide and rows that share an id are one document; texts of any length are taken
whole; an empty table gives an empty one; columns beyond those of ``documents`` are left behind, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, near_dup, packing, quality, shared, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score quality.THRESHOLD or more; each row is judged by its own text, an empty or null one like the empty text."""
    return quality.accepted(docs.select(*COLUMNS), shared.tables(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (shingles of five words, similarity 0.8).

    Texts without words, and rows with null ids, are in no group and stay."""
    gone = near_dup.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    gone = shared.Scratch(spark).keep(gone, "gone")  # written, its size is known: texts are only shuffled if the ids don't fit a broadcast
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller id has; other texts stay as they are.

    A null id counts as the largest; rows that share an id don't cut each other; a text cut to nothing stays as an empty one.
    """
    found = substring_dedup.deduplicate(docs, with_text=True).where("n_removed > 0")
    # Rows of one id and text are cut alike: one of them will do.
    found = found.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("kept_text").alias("_kept")).dropDuplicates(["_id", "_tag"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tag"))
    n_chars = F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.char_length("_kept").cast("long"))
    return docs.select(*COLUMNS).join(found, same, "left").select("doc_id", F.coalesce("_kept", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified test item; all rows of an id that has one go, null ids as one id."""
    leaked = decontamination.leaks(docs, shared.tables(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    leaked = shared.Scratch(spark).keep(leaked, "leaked")
    return docs.join(leaked, docs.doc_id.eqNullSafe(leaked.doc_id), "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is one piece, its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: The classifier, minwise tokens and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    scratch = shared.Scratch(spark)
    docs = shared.tables(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.keep(out, name)
        if k > 1:
            scratch.drop(STAGES[k - 2][0])
    return docs
