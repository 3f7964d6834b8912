"""Opening hours, written ``HH:MM-HH:MM`` or ``24/7``, in minutes of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*$"


def _minutes(hours: Column, at: int) -> Column:
    h, m = (F.regexp_extract(hours, PATTERN, k).try_cast("int") for k in (at, at + 1))
    return h * 60 + m


def opening(hours: Column) -> Column:
    return F.when(hours == "24/7", F.lit(0)).otherwise(_minutes(hours, 1))


def closing(hours: Column) -> Column:
    """Closing minute as written; 1440 for round the clock; null if it can't be read."""
    return F.when(hours == "24/7", F.lit(1440)).otherwise(_minutes(hours, 3))


def late_closing(hours: Column) -> Column:
    """Closing minute, counted on into the next day if it isn't after the opening."""
    o, c = opening(hours), closing(hours)
    return F.when(hours == "24/7", F.lit(1440)).when(c <= o, c + 1440).otherwise(c)


def is_open(hours: Column, minute: Column | int) -> Column:
    """Open at this minute? Spans over midnight wrap; what can't be read is closed."""
    at = minute if isinstance(minute, Column) else F.lit(minute)
    o, c = opening(hours), closing(hours)
    return F.coalesce(F.when(c <= o, (at >= o) | (at < c)).otherwise((at >= o) & (at < c)), F.lit(False))


def clock(minutes: Column) -> Column:
    return F.when(minutes.isNotNull(), F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")))
