"""Ranking evaluation: hits, reciprocal ranks, recall, groups, comparison with a baseline, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, hit1, rr, r3, r5, synth3, synth_above; ranked: query_id, id, rank, is_synthetic; gold: query_id, id."""
    g = gold.select("query_id", "id").repartition("query_id", "id").distinct()  # dealt first: a task that reads gold holds none of it
    n = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return measured(ranked.join(g.withColumn("hit", F.lit(True)), ["query_id", "id"], "left"), n)


def measured(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from rows that say who is gold; rows: query_id, rank, is_synthetic, hit; sizes: query_id, n_gold."""
    hit, synthetic = F.col("hit"), F.col("is_synthetic")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    agg = rows.groupBy("query_id").agg(
        F.max(F.when(hit & (F.col("rank") == 1), 1.0).otherwise(0.0)).alias("hit1"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        count(hit & (F.col("rank") <= 3)).alias("h3"),
        count(hit & (F.col("rank") <= 5)).alias("h5"),
        count(synthetic & (F.col("rank") <= 3)).alias("synth3"),
        F.min(F.when(synthetic, F.col("rank"))).alias("first_synthetic"),
    )
    above = F.when(F.col("first_synthetic") < F.coalesce("first", F.lit(2147483647)), 1).otherwise(0)
    out = agg.join(sizes, "query_id")
    return out.select("query_id", "hit1", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("h3") / F.col("n_gold")).alias("r3"), (F.col("h5") / F.col("n_gold")).alias("r5"), "synth3", above.alias("synth_above"))


def report_order(groups: DataFrame) -> DataFrame:
    """Groups of a report (kind, name, n): all first, then by kind, the largest first, equals by name."""
    return groups.orderBy(F.when(F.col("kind") == "all", 0).otherwise(1), "kind", F.desc("n"), "name")


def stress(search, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """Metrics of other wordings: queries (query_id, query, gold_from) are searched, and their gold is that of query ``gold_from``."""
    own = queries.select("query_id", "gold_from").join(gold.select(F.col("query_id").alias("gold_from"), "id"), "gold_from").select("query_id", "id")
    return per_query(search(queries.select("query_id", "query")), own)


def by_group(search, queries: DataFrame) -> DataFrame:
    """Means per group of hard queries, in report order; queries: query_id, query, group, gold (array of ids; an empty one is left out)."""
    rows = queries.where(F.size("gold") > 0)
    found = per_query(search(rows.select("query_id", "query")), rows.select("query_id", F.explode("gold").alias("id")))
    return means(found.join(rows.select("query_id", F.col("group").alias("name")), "query_id"), "name").orderBy(F.desc("n"), "name")


def benchmark(found: DataFrame, queries: DataFrame) -> DataFrame:
    """split, value, n, hits and the interval of hit1: overall, by difficulty, by variant and for queries with a hard negative.

    found: query_id, hit1; queries: query_id, difficulty, variant, has_hard_negative.
    """
    rows = found.select("query_id", "hit1").join(queries, "query_id")
    hard = F.when(F.col("has_hard_negative"), F.struct(F.lit("hard_negative").alias("split"), F.lit("yes").alias("value")))
    splits = F.array(F.struct(F.lit("all").alias("split"), F.lit("all").alias("value")), F.struct(F.lit("difficulty").alias("split"), F.col("difficulty").alias("value")), F.struct(F.lit("variant").alias("split"), F.col("variant").alias("value")), hard)
    each = rows.select("hit1", F.explode(F.filter(splits, lambda s: s.isNotNull())).alias("s")).groupBy("s.split", "s.value").agg(F.count("*").alias("n"), F.sum("hit1").alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return each.select("split", "value", "n", "hits", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


METRICS = ("hit1", "rr", "r3", "r5")


def means(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS], F.sum("synth3").alias("synth3"), F.sum("synth_above").alias("synth_above"))


def grouped(rows: DataFrame) -> DataFrame:
    """Overall, by difficulty and by category in one pass."""
    sets = rows.groupingSets([[], ["difficulty"], ["category"]], "difficulty", "category")
    return sets.agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS]).select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "difficulty").otherwise("category").alias("kind"), F.coalesce("difficulty", "category", F.lit("all")).alias("name"), "n", *METRICS)


def against(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """query_id, verdict: saved, regressed or same, by hits at rank 1."""
    b = baseline.select("query_id", F.col("hit1").alias("before"))
    return current.join(b, "query_id").select("query_id", F.when((F.col("hit1") > 0) & (F.col("before") == 0), "saved").when((F.col("hit1") == 0) & (F.col("before") > 0), "regressed").otherwise("same").alias("verdict"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share; (0, 0) without trials."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    centre, spread, scale = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return F.coalesce((centre - spread) / scale, F.lit(0.0)), F.coalesce((centre + spread) / scale, F.lit(0.0))


def satisfaction(rows: DataFrame) -> DataFrame:
    """Per query: accuracy over constraints, and whether all are right; rows: query_id, constraint_id, truth, score."""
    right = (F.col("score") >= 0.5) == (F.col("truth") >= 0.5)
    return rows.groupBy("query_id").agg(F.avg(right.cast("double")).alias("accuracy"), F.bool_and(right).alias("exact"))


def failure_kind(resolved: Column, score: Column, metres: Column, least: float = 0.70, most: float = 500.0) -> Column:
    return F.when(~resolved, "no_resolve").when(score < least, "score_low").when(metres > most, "coords_off").otherwise("verified")
