"""Filters: conjunctions of optional predicates, clean-up masks, accept rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(predicates: Iterable[Column | None]) -> Column:
    """The conjunction of the predicates given; absent ones add nothing."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def named(name: str | None, columns: list[str]) -> Column | None:
    """Case-insensitive contains: the whole name, or any of its words, in any of the columns; wildcards are not escaped."""
    if not name or not name.strip():
        return None
    parts = list(dict.fromkeys([name.strip(), *name.split()]))
    return any_of(F.coalesce(F.col(c).ilike(f"%{p}%"), F.lit(False)) for p in parts for c in columns)


def on_day(ts: str, day: str | None) -> Column | None:
    """A calendar day as a half-open range, which scans can prune by."""
    return None if day is None else (F.col(ts) >= F.lit(day).cast("timestamp_ntz")) & (F.col(ts) < F.lit(day).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))


def since(ts: str, now: str, days: int | None) -> Column | None:
    return None if days is None else F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def at_hour(ts: str, hour: int | None) -> Column | None:
    return None if hour is None else F.hour(ts) == hour


def equals(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def clamp(n: object, default: int, cap: int) -> int | None:
    """A limit between 1 and cap; 'all', 'none', 'unlimited', 0 and -1 mean no limit (None)."""
    if isinstance(n, str) and n.strip().lower() in ("all", "none", "unlimited", "0", "-1"):
        return None
    if n in (0, -1):
        return None
    return max(1, min(cap, int(n or default)))


#: How far back each preset reaches, in days; None: everything, 'today': since midnight.
PRESETS = {"today": "today", "24h": 1, "7d": 7, "30d": 30, "all": None}


def preset(ts: str, now: str, name: str) -> Column | None:
    days = PRESETS[name]
    if days == "today":
        return F.col(ts) >= F.date_trunc("day", F.lit(now).cast("timestamp")).cast("timestamp_ntz")
    return since(ts, now, days)


def accepted(similarity: Column, margin: Column, quality: Column, least: tuple[float, float, float] = (0.62, 0.03, 0.55)) -> Column:
    """The match rule: similarity must reach its least; a null margin or quality passes."""
    return F.coalesce((similarity >= least[0]), F.lit(False)) & F.coalesce(margin >= least[1], F.lit(True)) & F.coalesce(quality >= least[2], F.lit(True))


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())


def first_reason(rules: dict[str, Column]) -> Column:
    return reduce(lambda acc, item: acc.when(item[1], F.lit(item[0])), list(rules.items())[1:], F.when(next(iter(rules.values())), F.lit(next(iter(rules)))))


def drop_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: rows, kept, and how many rows each rule alone would drop (masks counted independently)."""
    bad = any_of(F.coalesce(r, F.lit(False)) for r in rules.values())
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("kept"), *(F.count_if(r).alias(name) for name, r in rules.items()))


def one_of(column: Column, allowed: list[str], default: str) -> Column:
    """Upper-case and trimmed if allowed, else the default."""
    up = F.upper(F.trim(column))
    return F.when(up.isin(*allowed), up).otherwise(F.lit(default))


def pose_quality(frames: Column, confidence: Column, keypoints: Column, ambiguous: Column, low_iou: Column) -> Column:
    """Why a pose window is too poor to be judged, the first reason in this order; null if it isn't.  A missing share or confidence counts as 0.

    frames, keypoints: shares of valid frames and keypoints; ambiguous, low_iou: frames rejected for either.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(zero(frames) < 0.85, "few_valid_frames").when(zero(confidence) < 0.70, "low_confidence").when(zero(keypoints) < 0.80, "few_valid_keypoints")
        .when(zero(ambiguous) >= 3, "ambiguous_poses").when(zero(low_iou) >= 3, "low_overlap")
    )
