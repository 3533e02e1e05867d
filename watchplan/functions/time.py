"""Dates, durations and frames as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_ms(c: Column) -> Column:
    """Milliseconds of 'PT1.5S', 'PT2M3S', 'HH:MM:SS.fff' or a plain number of milliseconds; null otherwise."""
    number = lambda p, k: F.coalesce(F.regexp_extract(c, p, k).try_cast("double"), F.lit(0.0))
    iso, clock = r"^PT(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?$", r"^(\d+):(\d+):(\d+(?:\.\d+)?)$"
    total = lambda p: (number(p, 1) * 3600 + number(p, 2) * 60 + number(p, 3)) * 1000
    return F.when(c.rlike(iso), total(iso)).when(c.rlike(clock), total(clock)).otherwise(c.try_cast("double"))


def safe_date(c: Column, default: str) -> Column:
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.lit(default).cast("date"))


def relative_date(c: Column, today: str) -> Column:
    day = F.lit(today).cast("date")
    return F.when(F.lower(c) == "today", day).when(F.lower(c) == "yesterday", F.date_sub(day, 1)).otherwise(safe_date(c, today))


def frame_seconds(frame: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame / fps)
