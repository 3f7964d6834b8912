"""Connected components of a distributed graph: alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, Scratch

#: Ids that a task's forest holds at once.
FOREST_IDS = 300_000


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars of its own components; a full forest is put out and begun anew."""

    def stars(forest: Forest) -> pa.RecordBatch:
        pairs = [(x, forest.root(x)) for x in list(forest.up) if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > FOREST_IDS:
            yield stars(forest)
            forest = Forest()
    if forest.up:
        yield stars(forest)


def connected(edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """(id, root): every id of ``edges`` (a, b) with the smallest id of its component.

    A step points all neighbours of an id at the smallest of them; both kinds of step are one aggregation
    and one join on edges, which only shrink in reach.  No component is gathered anywhere.  Aggregates are combined in
    the tasks first and written, so that each join has a shuffle of its own on either side: a hub's edges are then
    dealt to several tasks by the adaptive skew join.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").mapInArrow(forests, "a long, b long"), f"{name}_0")
    before, done = None, None
    for k in range(1, most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), f"{name}_least")
        # Every edge gives one row in either step, so the graph never grows and needs no distinct.
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large, f"{name}_large")
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), f"{name}_near")
        small = large.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = scratch.keep(small.mapInArrow(forests, "a long, b long"), f"{name}_{k}")
        done = now.groupBy("a").agg(F.min("b").alias("b")).agg(F.count("*"), F.count_if(F.col("a") < F.col("b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}_{k - 1}", f"{name}_least", f"{name}_large", f"{name}_near")
        if done == before:
            break
        before = done
    else:
        raise RuntimeError("components did not settle")
    now = now.distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
