"""Ordered operators per track: smoothing, persistence, events, sessions, strided windows.

A track's key partitions the data and its rows are streamed in order; only bounded frames are
gathered.  What needs its own last output (cooldowns) is a fold over the track in an Arrow group function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def track(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def weights(sigma: float, radius: int) -> list[float]:
    """Gaussian weights by distance 0, 1, ..., radius."""
    return [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(radius + 1)]


def causal_gaussian(score: str, w: WindowSpec, sigma: float) -> Column:
    """Weighted mean of the row and up to ceil(3 sigma) rows before it; weights are those of the rows there are.

    Sums of lagged products: no arrays are gathered.
    """
    if sigma <= 0:
        return F.col(score)
    terms = [(F.lag(score, k).over(w) if k else F.col(score), x) for k, x in enumerate(weights(sigma, math.ceil(3 * sigma)))]
    top = sum((F.coalesce(c * x, F.lit(0.0)) for c, x in terms), F.lit(0.0))
    return top / sum((F.when(c.isNotNull(), x).otherwise(0.0) for c, x in terms), F.lit(0.0))


def centred_gaussian(score: str, by: list[str], w: WindowSpec, sigma: float, radius: int, least: int = 3) -> Column:
    """Weighted mean of radius rows on each side, the first and last value standing in beyond the ends.

    Tracks of fewer than `least` rows stay as they are.
    """
    if sigma <= 0 or radius < 1:
        return F.col(score)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(score).over(whole), F.last(score).over(whole)
    by_distance = weights(sigma, radius)
    total = by_distance[0] + 2 * sum(by_distance[1:])
    smooth = F.col(score) * (by_distance[0] / total)
    for k in range(1, radius + 1):
        smooth += (F.coalesce(F.lag(score, k).over(w), first) + F.coalesce(F.lead(score, k).over(w), last)) * (by_distance[k] / total)
    return F.when(F.count(score).over(Window.partitionBy(*by)) < least, F.col(score)).otherwise(smooth)


def persistent(hit: Column, w: WindowSpec, n: int, m: int, now_too: bool = False) -> Column:
    """At least n of the last m rows hit; now_too: this row must as well."""
    enough = F.sum(hit.cast("int")).over(w.rowsBetween(-(m - 1), 0)) >= n
    return enough & hit if now_too else enough


def rising_edge(flag: str, w: WindowSpec) -> Column:
    return F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))


def islands(df: DataFrame, w: WindowSpec, new: Column, name: str) -> DataFrame:
    """df with the number of the island that a row is in; `new` says where one begins."""
    return df.withColumn(name, F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))


def gap_sessions(df: DataFrame, by: list[str], order: list[str], ts: str, gap_seconds: float, value: str) -> DataFrame:
    """Rows whose time to the row before is at most the gap belong together: per session start, end, rows, max, mean."""
    w = track(by, order)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    s = islands(df, w, seconds > gap_seconds, "session")
    return s.groupBy(*by, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows"), F.max(value).alias("top"), F.avg(value).alias("mean"))


def longest_run(df: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """The longest run of true rows per track; 0 where there is none."""
    w = track(by, order)
    r = df.withColumn("_run", F.row_number().over(w) - F.row_number().over(track([*by, flag], order)))
    n = r.groupBy(*by, "_run", flag).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("_n"))), F.lit(0)).alias("longest"))


def strided(df: DataFrame, by: list[str], order: list[str], length: int, stride: int, values: list[str]) -> DataFrame:
    """Windows of `length` rows whose first row's number (from 0) is a multiple of the stride, with the rows' values in order."""
    w = track(by, order)
    out = df.withColumn("start_index", F.row_number().over(w) - length).withColumn("rows", F.collect_list(F.struct(*values)).over(w.rowsBetween(-(length - 1), 0)))
    return out.where((F.col("start_index") >= 0) & (F.col("start_index") % stride == 0))


def segments(df: DataFrame, by: list[str], order: list[str], index: str, max_gap: int) -> DataFrame:
    """df with `segment`: a jump of the index by more than max_gap + 1 begins a new one."""
    w = track(by, order)
    return islands(df, w, F.col(index) - F.lag(index).over(w) > max_gap + 1, "segment")


def carried(value: str, at: str, w: WindowSpec, most_age: float) -> Column:
    """The last value that isn't null, if it is at most most_age old on the scale of `at`."""
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    age = F.col(at) - F.last(F.when(F.col(value).isNotNull(), F.col(at)), ignorenulls=True).over(before)
    return F.when(age <= most_age, F.last(value, ignorenulls=True).over(before))


def repaired(value: str, w: WindowSpec) -> Column:
    """Nulls filled from before, else from behind, else 0."""
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead, F.lit(0.0))


def fold_many(df: DataFrame, by: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, list]], finish: Callable[[object], list], columns: list[str]) -> DataFrame:
    """A sequential fold over each track: step(state, row) gives the next state and output rows, finish(state) those of the track's end.

    Tracks are dealt by key and streamed in order, whatever their length; the state alone is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(", ")]
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                own = row[: len(by)]
                if own != key:
                    out += finish(state) if key is not None else []
                    key, state = own, start()
                state, made = step(state, row)
                out += made
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame(finish(state), columns=names)

    return df.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def fold(df: DataFrame, by: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, list | None]], columns: list[str]) -> DataFrame:
    """fold_many where a row gives one output row or None, and a track's end none."""

    def one(state: object, row: tuple) -> tuple[object, list]:
        state, made = step(state, row)
        return state, [] if made is None else [made]

    return fold_many(df, by, order, schema, start, one, lambda state: [], columns)


def cooldown(df: DataFrame, by: list[str], order: list[str], seconds: str, gap: float, id_column: str, key_types: str) -> DataFrame:
    """Rows that emit an event: those at least `gap` seconds after the track's last emitted one."""

    def step(last, row):
        now = row[-2]
        if last is None or now - last >= gap:
            return now, [*row[: len(by)], row[-1]]
        return last, None

    return fold(df, by, order, f"{key_types}, {id_column} long", lambda: None, step, [c for c in order if c not in (seconds, id_column)] + [seconds, id_column])


def strided_by_gap(df: DataFrame, by: list[str], order: list[str], index: str, length: int, stride: int, id_column: str, key_types: str) -> DataFrame:
    """Live windows: once `length` rows are there, one is emitted where the index is `stride` past that of the last emitted."""

    def step(state, row):
        n, last = state
        n += 1
        if n >= length and (last is None or row[-2] - last >= stride):
            return (n, row[-2]), [*row[: len(by)], row[-1]]
        return (n, last), None

    return fold(df, by, order, f"{key_types}, {id_column} long", lambda: (0, None), step, [c for c in order if c not in (index, id_column)] + [index, id_column])


def debounced(df: DataFrame, by: list[str], order: list[str], flag: str, fire_at: int, id_column: str, key_types: str) -> DataFrame:
    """A counter goes up on a hit and down, to 0, without one; at fire_at it fires and starts anew."""

    def step(n, row):
        n = n + 1 if row[-2] else max(0, n - 1)
        return (0, [*row[: len(by)], row[-1]]) if n >= fire_at else (n, None)

    return fold(df, by, order, f"{key_types}, {id_column} long", lambda: 0, step, [c for c in order if c not in (flag, id_column)] + [flag, id_column])


def ground_points(df: DataFrame, by: list[str], seq: str, key_types: str, least: float = 0.35, most_age: int = 12) -> DataFrame:
    """by, seq, x, y, source of each row's ground point: the mean of its trusted ankles, the track's last point, or its box's bottom.

    df: lx, ly, lconf, rx, ry, rconf (ankles, null where there is none), bx, by_ (the middle of the box's lower side).  An ankle counts
    from a confidence of `least` on.  Without any, the last point stands for at most most_age of seq; beyond that the box's bottom does, and is
    itself the last point then, so later rows depend on it: a fold.
    """

    def step(last, row):
        at, *ankles, bx, by_ = row[len(by) :]
        good = [(x, y) for x, y, c in (ankles[:3], ankles[3:]) if x == x and y == y and c == c and None not in (x, y, c) and c >= least and math.isfinite(x) and math.isfinite(y)]
        if good:
            point, source = (sum(x for x, _ in good) / len(good), sum(y for _, y in good) / len(good)), "ankle_midpoint" if len(good) == 2 else "single_ankle"
        elif last is not None and at - last[1] <= most_age:
            return last, [*row[: len(by)], at, *last[0], "freeze_last_valid"]
        else:
            point, source = (bx, by_), "bbox_bottom"
        return (point, at), [*row[: len(by)], at, *point, source]

    return fold(df, by, [seq], f"{key_types}, {seq} long, x double, y double, source string", lambda: None, step, [seq, "lx", "ly", "lconf", "rx", "ry", "rconf", "bx", "by_"])
