"""Which labelled rows may be learned from, and a bounded, repeatable sample of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y (0/1), fold: one row per labelled id outside the held-out part; of contradicting labels the larger."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", fold_of(F.col("doc_id")))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their ids (ties by id); all rows, if there are no more.

    Rows are counted first, so that a cut-off on the hash leaves little more than ``most`` to sort: a task doesn't send on
    more rows than its share.  The cut-off is 10 standard deviations above what is needed.
    """
    n = rows.select("doc_id").count()
    share = min(1.0, (most + 10 * math.sqrt(most) + 100) / max(1, n))
    rank = F.xxhash64("doc_id")
    if share < 1:
        rows = rows.where(F.shiftrightunsigned(rank.bitwiseXOR(F.lit(-(2**63))), 24) < math.ceil(share * (1 << 40)))
    return rows.orderBy(rank, "doc_id").limit(most)
