"""Event-time windows over streams or tables: the same functions serve both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path).withWatermark("ts", late)


def _totals(rows: DataFrame, window: Column, *by: str) -> DataFrame:
    out = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(rows: DataFrame, size: str, *by: str) -> DataFrame:
    return _totals(rows, F.window("ts", size), *by)


def sliding(rows: DataFrame, size: str, step: str, *by: str) -> DataFrame:
    return _totals(rows, F.window("ts", size, step), *by)


def sessions(rows: DataFrame, gap: str, by: str) -> DataFrame:
    return _totals(rows, F.session_window("ts", gap), by)


def unique(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """First row per key; on a stream with a watermark the state is dropped behind it."""
    return rows.dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def run_once(result: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything that is there now, appended to Parquet; windows still open stay in the state."""
    query = result.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
