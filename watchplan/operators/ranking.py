"""Ranking and limits: priorities, pages, even samples, peaks, minimum-per-group samples, group splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(column: Column, values: list[str]) -> Column:
    """Place in a fixed order, unlisted values last."""
    out = F.lit(len(values))
    for k, v in reversed(list(enumerate(values))):
        out = F.when(column == v, F.lit(k)).otherwise(out)
    return out


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def even_sample(keys: Column, limit: int) -> Column:
    """At most `limit` of the keys, evenly spaced, the first and last among them; half goes to even."""
    n = F.size(keys)
    if limit <= 1:
        return F.slice(keys, 1, 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(limit - 1))).cast("int") + 1)
    return F.when(n <= limit, keys).otherwise(F.array_distinct(F.transform(at, lambda i: F.element_at(keys, i))))


def peaks(values: Column, most: int) -> Column:
    """Indices of peaks: greatest first, later first among equals, none beside a chosen one, none at or below 0.

    A greedy fold over the ranked indices of one array.
    """
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), asc=False)
    good = F.filter(ranked, lambda s: s["x"] > 0)
    add = lambda acc, s: F.when((F.size(acc) < most) & ~F.exists(acc, lambda i: F.abs(i - s["i"]) <= 1), F.concat(acc, F.array(s["i"]))).otherwise(acc)
    return F.aggregate(good, F.array().cast("array<int>"), add)


def even_samples(df: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """even_sample of each group with more than `limit` (at least 2) rows, as by and keys; rows are numbered in order, and only the places wanted are gathered."""
    n = df.groupBy(by).agg(F.count(key).alias("_n")).where(F.col("_n") > limit)
    numbered = df.where(F.col(key).isNotNull()).select(by, key, F.row_number().over(Window.partitionBy(by).orderBy(key)).alias("_r"))
    at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(limit - 1))) + 1)
    kept = numbered.join(n, by).where(F.array_contains(at, F.col("_r").cast("double")))
    return kept.groupBy(by).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_r", key))), lambda s: s[key])).alias("keys"))  # `limit` rows


def track_peaks(df: DataFrame, by: list[str], order: list[str], value: Column, most: int, key_types: str) -> DataFrame:
    """peaks of each track in its order, as by and peaks; the rows above 0 are streamed, greatest first, and only the chosen held.

    A row beside a greater one can be chosen (where that one is itself beside a chosen one), so all rows above 0 take part.
    """
    from watchplan.operators.windows import fold

    def step(chosen, row):
        i = row[-1]
        if len(chosen) < most and all(abs(i - j) > 1 for j in chosen):
            return [*chosen, i], [*row[: len(by)], len(chosen), i]
        return chosen, None

    high = df.select(*by, value.alias("_x"), (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).alias("_i")).where("_x > 0")
    found = fold(high, by, [F.desc("_x"), F.desc("_i")], f"{key_types}, _n int, _i int", list, step, ["_x", "_i"])
    lists = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_i"))), lambda s: s["_i"]).alias("peaks"))  # at most `most` rows
    return df.select(*by).distinct().join(lists, by, "left").select(*by, F.coalesce("peaks", F.array().cast("array<int>")).alias("peaks"))


def enough_of_each(df: DataFrame, by: str, least: int, take: int, order: list[str]) -> DataFrame:
    """`take` rows of every group that has at least `least`."""
    w = Window.partitionBy(by)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).where((F.col("_n") >= least) & (F.col("_r") <= take)).drop("_n", "_r")


def group_split(df: DataFrame, group: str, shares: tuple[float, float], seed: int) -> DataFrame:
    """df with `split`: whole groups go to train, calibration or test.

    Groups are ordered by a seeded hash; sizes are rounded, at least 1.  Groups' places come from counts per hash
    bucket and an order inside a bucket, so no task sorts all groups.
    """
    groups = df.select(group).distinct().withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long"))
    groups = groups.withColumn("_b", F.floor(F.col("_h") / float(1 << 38)).cast("int"))  # 1024 buckets
    counts = groups.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_total"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 1024 rows
    place = groups.join(F.broadcast(before), "_b").crossJoin(F.broadcast(total)).withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", group)))
    n_train, n_cal = (F.greatest(F.lit(1), F.bround(F.col("_total") * s)) for s in shares)
    split = F.when(F.col("_place") <= n_train, "train").when(F.col("_place") <= n_train + n_cal, "calibration").otherwise("test")
    return df.join(place.select(group, split.alias("split")), group)


def around_peaks(scores: np.ndarray, n: int, most: int) -> list[int]:
    """Frames of n to keep, `most` at most: the first and last, then each peak with its neighbours, greatest first, then evenly spaced ones, then any.

    scores[t] is the change from frame t to t + 1.  Peaks are above 0 and not beside one taken before; of equal ones the later is first.
    """
    if n <= most:
        return list(range(n))
    kept = list(dict.fromkeys([0, n - 1]))[:most]
    peaks: list[int] = []

    def keep(frames: Iterable[int]) -> None:
        for f in frames:
            if len(kept) < most and 0 <= f < n and f not in kept:
                kept.append(f)

    for t in np.lexsort((-np.arange(len(scores)), -np.where(np.isfinite(scores), scores, -np.inf))).tolist():
        if len(kept) >= most or not np.isfinite(scores[t]) or scores[t] <= 0:
            break
        if all(abs(t + 1 - p) > 1 for p in peaks):
            peaks.append(t + 1)
            keep((t, t + 1, t + 2))
    keep(evenly(n, most))
    keep(range(n))
    return sorted(kept)


def evenly(n: int, most: int) -> list[int]:
    """`most` of n places, evenly spaced, first and last among them; all if there are no more."""
    if n <= most:
        return list(range(n))
    return [0] if most == 1 else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


#: Gates, their other names, and what the frames of their events are chosen by, in order of preference.
_CHOSEN_BY = {"deep": ["image"], "pose": ["energy", "box", "image"], "homography_macro": ["trajectory"]}
_ALIASES = {"homography": "homography_macro", "macro": "homography_macro", "homography macro": "homography_macro"}
KEY_FRAMES = "frames array<int>, selector string, basis string, total int, peaks array<int>"


def chosen_frames(gate: str | None, total: int, scores: dict[str, np.ndarray | None], most: int) -> tuple[list[int], str, str, list[int]]:
    """(frames, selector, basis, peaks) of one event, by its gate; evenly spaced ones where the gate is unknown or nothing moves."""
    name = (gate or "").strip().lower()
    name = _ALIASES.get(name, name)
    if total == 0:
        return [], "even_spacing", "no_frames", []
    if name not in _CHOSEN_BY:
        return evenly(total, most), "even_spacing", "unknown_gate", []
    if total <= most:
        return list(range(total)), name, "all_frames", []
    wanted = _CHOSEN_BY[name]
    for k, basis in enumerate(wanted):
        own = scores.get(basis)
        # a pose's own energies decide as soon as there are any; else whatever moves
        if own is None or (k + 1 < len(wanted) and basis != "energy" and not (own > 0).any()):
            continue
        if not (own > 0).any():
            if name == "pose":
                return evenly(total, most), "even_spacing", "nothing_moves", []
        return around_peaks(own, total, most), name, basis, best_peaks(own)
    return evenly(total, most), "even_spacing", "nothing_moves" if name == "pose" else f"no_{wanted[0]}", []


def best_peaks(scores: np.ndarray, most: int = 5) -> list[int]:
    """The frames of the greatest peaks, greatest first, none beside another."""
    out: list[int] = []
    for t in np.lexsort((-np.arange(len(scores)), -np.where(np.isfinite(scores), scores, -np.inf))).tolist():
        if np.isfinite(scores[t]) and scores[t] > 0 and len(out) < most and all(abs(t + 1 - p) > 1 for p in out):
            out.append(t + 1)
    return out


def key_frames(events: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, frames, selector, basis, total, peaks of each event: which of its frames are looked at, and why (the audit row).

    events: key, gate, total (frames), and arrays of changes from frame to frame: energy, box, image, trajectory (null: not known).  An event is one row
    with its few frames.  Most of the changes are window expressions: motion.box_transition, motion.trajectory_change, motion.energies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, gate, total, *arrays in pdf.itertuples(index=False, name=None):
                scores = {n: None if a is None else np.nan_to_num(np.array([np.nan if x is None else x for x in a], float), nan=0.0, posinf=np.inf, neginf=-np.inf) for n, a in zip(("energy", "box", "image", "trajectory"), arrays, strict=True)}
                frames, selector, basis, peaks = chosen_frames(gate, int(total), scores, most)
                out.append((k, frames, selector, basis, int(total), peaks))
            yield pd.DataFrame(out, columns=[key, "frames", "selector", "basis", "total", "peaks"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "gate", "total", "energy", "box", "image", "trajectory").mapInPandas(run, f"{key} {kind}, {KEY_FRAMES}")
