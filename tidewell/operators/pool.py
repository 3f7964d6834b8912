"""Candidate pools: union of channels, normalisation within a query, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(channels: dict[str, DataFrame], k: int) -> DataFrame:
    """query_id, id, a nullable score per channel: the first k of each channel (query_id, id, score, rank)."""
    long = reduce(DataFrame.unionByName, [c.where(F.col("rank") <= k).select("query_id", "id", F.lit(n).alias("channel"), "score") for n, c in channels.items()])
    return long.groupBy("query_id", "id").agg(*[F.max(F.when(F.col("channel") == n, F.col("score"))).alias(n) for n in channels])


def normalised(score: Column, by: str = "query_id") -> Column:
    """Min-max within the pool: absent rows 0, a flat channel 1 where present, a channel without any row 0.5."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi.isNull(), 0.5).when(score.isNull(), 0.0).when(hi == lo, 1.0).otherwise((score - lo) / (hi - lo))


def rank_score(rank: Column, by: str = "query_id") -> Column:
    """1 - (rank - 1) / rows, for a channel that gives an order only."""
    return 1.0 - (rank - 1) / F.count("*").over(Window.partitionBy(by))


def ranked(rows: DataFrame, *order: Column, by: str = "query_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
