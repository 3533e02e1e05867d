"""Exact percentiles of groups of any size.

A built-in exact percentile keeps all distinct values of a group in one buffer, which is fine for groups of bounded size.  In larger
groups the ranks that are asked for are narrowed down: a histogram of the range in which a rank lies, then of the one cell that
holds it, between the least and greatest value that the cell has, until the cell is a single value or few enough to sort.  Every round is one
pass whose partial sums are a row for each cell; ranks, bounds and counts are a small written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchplan.operators.joins import small
from watchplan.sources.shared import folder, written

#: Rows of a group, or of a cell, whose values may be held at once.
HELD = 1_000_000
#: Cells of a histogram.
CELLS = 512


def finite(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.where(x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf")))


def percentiles(df: DataFrame, by: list[str], column: str, points: list[float], held: int = HELD, cells: int = CELLS, most_rounds: int = 300) -> DataFrame:
    """(by, point, threshold): percentiles with linear interpolation of the finite values of each group that has any.

    points: 0 to 100.  held: groups of up to so many rows take the built-in way.  Group keys that are null are a group.
    """
    rows = finite(df, column).select(*by, F.col(column).cast("double").alias("_v"))
    largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = folder(df.sparkSession)
    groups = written(largest, f"{place}/groups")
    if groups.where(F.col("_n") > held).isEmpty():
        return _built_in(rows, by, points)
    large = groups.where(F.col("_n") > held)
    keys = [F.col(f"_k{k}").eqNullSafe(F.col(b)) for k, b in enumerate(by)]
    known = small(large.select(*(F.col(b).alias(f"_k{k}") for k, b in enumerate(by)), F.lit(1).alias("_large")))
    on = reduce(lambda a, b: a & b, keys) if keys else F.lit(True)
    few = _built_in(rows.join(known, on, "left_anti"), by, points) if by else None
    many = written(_ranked(rows, large, by, points, place, held, cells, most_rounds), f"{place}/ranks")
    # each point from the values at its two ranks
    targets = large.select(*by, "_n", F.explode(F.array(*map(F.lit, points))).alias("point")).withColumn("_at", F.col("point") / 100 * (F.col("_n") - 1))
    for side, rank in (("_a", F.floor("_at")), ("_b", F.ceil("_at"))):
        own = small(many.select(*(F.col(b).alias(f"_k{k}") for k, b in enumerate(by)), F.col("_rank").alias("_r"), F.col("_value").alias(side)))
        targets = targets.join(own, reduce(lambda a, b: a & b, keys, rank == F.col("_r"))).drop("_r", *(f"_k{k}" for k in range(len(by))))
    share = F.col("_at") - F.floor("_at")
    out = targets.select(*by, "point", F.when(share == 0, F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b")).alias("threshold"))
    return out if few is None else few.unionByName(out)


def _built_in(rows: DataFrame, by: list[str], points: list[float]) -> DataFrame:
    got = rows.groupBy(*by).agg(F.percentile("_v", F.array(*(F.lit(p / 100) for p in points))).alias("_p")).where("_p IS NOT NULL")
    return got.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, points)), "_p")).alias("point", "threshold"))


def _ranked(rows: DataFrame, large: DataFrame, by: list[str], points: list[float], place: str, held: int, cells: int, most_rounds: int) -> DataFrame:
    """(by, _rank, _value) for the ranks on both sides of each point."""
    names = [f"_k{k}" for k in range(len(by))]
    at = F.transform(F.array(*(F.lit(p / 100) for p in points)), lambda p: p * (F.col("_n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))
    state = large.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"))
    state = written(state, f"{place}/state-0")
    for k in range(1, most_rounds + 1):
        wide = state.where((F.col("_in") > held) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        met = _within(rows, wide, by, names)
        # of a range wider than a double the halves are taken, so that nothing overflows
        cell = F.least(F.lit(cells - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * cells))
        counted = met.groupBy(*names, "_rank", "_below", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        until = F.sum("_in").over(Window.partitionBy(*names, "_rank").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))  # at most `cells` rows
        found = counted.withColumn("_until", F.col("_below") + until).where((F.col("_until") > F.col("_rank")) & (F.col("_until") - F.col("_in") <= F.col("_rank")))
        narrower = found.select(*names, "_rank", "_lo", "_hi", (F.col("_until") - F.col("_in")).alias("_below"), "_in")
        rest = state.where(~((F.col("_in") > held) & (F.col("_lo") < F.col("_hi"))))
        state = written(narrower.unionByName(rest.select(*narrower.columns)), f"{place}/state-{k}")
    else:
        raise RuntimeError(f"ranks have not settled after {most_rounds} rounds")
    single = state.where("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_value"))
    cells_left = state.where("_lo < _hi")
    sorted_ = _within(rows, cells_left, by, names).groupBy(*names, "_rank", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # at most `held` values
    exact = sorted_.select(*names, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value"))
    return single.unionByName(exact).select(*(F.col(n).alias(b) for b, n in zip(by, names, strict=True)), "_rank", "_value")


def _within(rows: DataFrame, state: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    keys = [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)]
    return rows.join(small(state), reduce(lambda a, b: a & b, keys, inside)).drop(*by)


def with_percentiles(aggregated: DataFrame, df: DataFrame, by: list[str], column: str, points: dict[str, float], held: int = HELD) -> DataFrame:
    """aggregated (a row for each group, or one row without by) with a column for each point, by name; null where a group has no finite value."""
    long = percentiles(df, by, column, sorted(set(points.values())), held)
    wide = long.groupBy(*(F.col(b).alias(f"_k{k}") for k, b in enumerate(by))).agg(*(F.max(F.when(F.col("point") == p, F.col("threshold"))).alias(n) for n, p in points.items()))
    if not by:
        return aggregated.crossJoin(F.broadcast(wide))  # one row each
    return aggregated.join(wide, reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_k{k}")) for k, b in enumerate(by))), "left").drop(*(f"_k{k}" for k in range(len(by))))
