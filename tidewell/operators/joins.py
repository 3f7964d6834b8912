"""Joins on conditions: edit distance, word boundaries, ranges, places in a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edit1_pairs(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, candidate at edit distance 1; words: token, vocabulary: candidate.

    Two strings one edit apart share one of their deletion variants (a string itself, or less one character), so the
    pairs come from an equi-join on variants, and the distance is only computed for these.
    """

    def variants(df: DataFrame, col: str) -> DataFrame:
        c = F.col(col)
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return df.select(col, F.explode(F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))))).alias("variant"))

    pairs = variants(words.select("token").distinct(), "token").join(variants(vocabulary.select("candidate").distinct(), "candidate"), "variant")
    return pairs.where(F.levenshtein("token", "candidate") == 1).select("token", "candidate").distinct()


def unique_candidates(pairs: DataFrame) -> DataFrame:
    """Tokens with exactly one candidate."""
    return pairs.groupBy("token").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).where("n = 1").select("token", "candidate")


def boundary(surface: Column) -> Column:
    """Pattern of a folded surface that isn't flanked by letters or digits."""
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), surface, F.lit(r"\E(?![a-z0-9])"))


def surface_matches(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """query_id, key, surface for lexicon surfaces that occur as words; the lexicon is small and broadcast."""
    return queries.join(F.broadcast(lexicon), F.expr(r"query rlike concat('(?<![a-z0-9])\\Q', surface, '\\E(?![a-z0-9])')")).select("query_id", "key", "surface")


def box_join(points: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """points (lat, lon) inside boxes (lat_lo, lat_hi, lon_lo, lon_hi): an equi-join on grid cells, then the exact test."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.withColumn("_y", F.explode(F.sequence(at("lat_lo"), at("lat_hi")))).withColumn("_x", F.explode(F.sequence(at("lon_lo"), at("lon_hi"))))
    keyed = points.withColumn("_y", at("lat")).withColumn("_x", at("lon"))
    return keyed.join(cells, ["_y", "_x"]).where("lat between lat_lo and lat_hi and lon between lon_lo and lon_hi").drop("_y", "_x")
