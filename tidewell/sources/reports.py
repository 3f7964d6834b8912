"""Sinks for results: API responses, evaluation reports, a table row in a document, JSON logs."""

from __future__ import annotations

import json
import logging
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.text import address_line, place_id

#: Response fields that an API client relies on.
REQUIRED = ("id", "name", "category", "address", "location", "score")


def place_result(user: tuple[float, float] | None = None, explain: bool = False) -> Column:
    """One result as a struct; unknown distances and missing parts are null, and JSON leaves nulls out."""
    known = (F.col("lat") != 0) | (F.col("lon") != 0)
    metres = F.when(known, (haversine_km(F.lit(user[0]), F.lit(user[1]), F.col("lat"), F.col("lon")) * 1000).cast("int")) if user else F.lit(None).cast("int")
    parts = [
        place_id(F.col("poi_id")).alias("id"), F.col("name"), F.col("category"), address_line(F.col("district"), F.col("city")).alias("address"),
        F.when(known, F.struct("lat", "lon")).alias("location"), F.when(F.col("rating") > 0, F.round("rating", 1)).alias("rating"), metres.alias("distanceMeters"), F.round("score", 4).alias("score"),
    ]
    if explain:
        parts += [F.col(c) for c in ("detail", "relaxed")]
    return F.struct(*parts)


def responses(rows: DataFrame, user: tuple[float, float] | None = None, explain: bool = False) -> DataFrame:
    """query_id, body: the results of a query in their order as one JSON object; rows: at most a page per query."""
    one = rows.select("query_id", "place", place_result(user, explain).alias("r"))
    return one.groupBy("query_id").agg(F.to_json(F.struct(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("place", "r"))), lambda s: s["r"]).alias("results"))).alias("body"))


def contract_gaps(schema_fields: list[str]) -> list[str]:
    """Required response fields that are missing."""
    return sorted(set(REQUIRED) - set(schema_fields))


def report(metrics: DataFrame, folder: str, label: str, now: float | None = None) -> str:
    """Write metrics as JSON lines under a name with the time; returns the folder."""
    stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime(now))
    where = f"{folder.rstrip('/')}/{re.sub('[^a-z0-9]+', '_', label.lower())}_{stamp}"
    metrics.write.json(where)
    return where


def with_row(text: str, label: str, cells: list[str]) -> str:
    """A Markdown document with the table row of this label replaced, or added behind the last row."""
    row = f"| {' | '.join([label, *cells])} |"
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.startswith(f"| {label} |")]
    if at:
        lines[at[0]] = row
    else:
        last = max((i for i, x in enumerate(lines) if x.startswith("|")), default=len(lines) - 1)
        lines.insert(last + 1, row)
    return "\n".join(lines)


class JsonLines(logging.Formatter):
    """One JSON object a record; values given as ``extra={"fields": {...}}`` become its fields."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out | getattr(record, "fields", {}), ensure_ascii=False)
