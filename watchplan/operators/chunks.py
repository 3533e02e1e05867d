"""Ordered operators on tracks longer than a task: chunks of a track, and summaries that combine.

A track's rows are cut into chunks by their order (time, say), and chunks are dealt to tasks like keys of their own.  Within a chunk the
usual windows run.  Each chunk has a summary (runs at its ends, its best run, its last rows, its first and last time), and
summaries combine from left to right, one row for a chunk, to what a chunk must know of those before it.  Chunks must
follow the order: no row of a later chunk comes before one of an earlier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchplan.operators.joins import small

CHUNK = "_chunk"


def by_time(ts: str, seconds: float) -> Column:
    """Chunks of so many seconds; rows without time are the first one."""
    return F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1e6)), F.lit(-(1 << 62)))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join to a row for each chunk; null keys are keys."""
    r = small(right.select(*(F.col(k).alias(f"_j{n}") for n, k in enumerate(keys)), *(c for c in right.columns if c not in keys)))
    return left.join(r, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_j{n}")) for n, k in enumerate(keys))), "left").drop(*(f"_j{n}" for n in range(len(keys))))


def _cut(df: DataFrame, by: list[str], order: list[str], chunk: Column) -> tuple[DataFrame, list[str], Window]:
    own = [*by, CHUNK]
    return df.withColumn(CHUNK, chunk), own, Window.partitionBy(*own).orderBy(*order)


def longest_run(df: DataFrame, by: list[str], order: list[str], flag: str, chunk: Column) -> DataFrame:
    """windows.longest_run: by, longest.

    A chunk's summary is its rows, the run that it begins with, that it ends with, and its longest.
    """
    rows, own, w = _cut(df, by, order, chunk)
    n = F.row_number().over(w)
    runs = rows.withColumn("_n", n).withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*own, flag).orderBy(*order)))
    runs = runs.groupBy(*own, "_run", flag).agg(F.count(F.lit(1)).alias("_size"), F.min("_n").alias("_from"), F.max("_n").alias("_to"))
    hit = lambda c: F.coalesce(F.max(F.when(F.col(flag) & c, F.col("_size"))), F.lit(0))
    size = F.max(F.struct("_to", F.lit(0)))["_to"]
    ends = runs.withColumn("_all", F.max("_to").over(Window.partitionBy(*own)))
    chunks = ends.groupBy(*own).agg(size.alias("rows"), hit(F.lit(True)).alias("best"), hit(F.col("_from") == 1).alias("first"), hit(F.col("_to") == F.col("_all")).alias("last"))
    lists = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(CHUNK, "rows", "best", "first", "last"))).alias("c"))  # a track's chunks
    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("best"))

    def step(s: Column, c: Column) -> Column:
        through = s["open"] + c["first"]
        return F.struct(F.when(c["first"] == c["rows"], through).otherwise(c["last"]).alias("open"), F.greatest(s["best"], c["best"], through).alias("best"))

    return lists.select(*by, F.aggregate("c", start, step)["best"].alias("longest"))


def gap_sessions(df: DataFrame, by: list[str], order: list[str], ts: str, gap_seconds: float, value: str, chunk: Column) -> DataFrame:
    """windows.gap_sessions: by, session, start, end, rows, top, mean.

    Sessions of a chunk are summed first; a chunk's first one goes on with the last one before it unless the gap between is too long.
    """
    rows, own, w = _cut(df, by, order, chunk)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6 > gap_seconds
    local = rows.withColumn("_local", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    sums = local.groupBy(*own, "_local").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows"), F.max(value).alias("top"), F.sum(value).alias("_sum"), F.count(value).alias("_values"))
    ends = sums.groupBy(*own).agg(F.min("start").alias("_first"), F.max("end").alias("_last"), F.count(F.lit(1)).alias("_sessions"))
    over = Window.partitionBy(*by).orderBy(CHUNK)  # a track's chunks
    apart = F.coalesce((micros("_first") - F.lag(micros("_last")).over(over)) / 1e6 > gap_seconds, F.lit(True))
    ends = ends.withColumn("_joins", F.when(apart, 0).otherwise(1))
    before = F.coalesce(F.sum("_sessions").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_joins").over(over.rowsBetween(Window.unboundedPreceding, 0))
    numbered = _joined(sums, ends.select(*own, before.alias("_before")), own).withColumn("session", F.col("_local") + F.col("_before"))
    out = numbered.groupBy(*by, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").alias("rows"), F.max("top").alias("top"), (F.sum("_sum") / F.sum("_values")).alias("mean"))
    return out


def with_tail(df: DataFrame, by: list[str], order: list[str], value: str, length: int, chunk: Column, name: str) -> DataFrame:
    """df, with its chunk, and as `name` the last `length` values, oldest first, of the rows before the row's chunk: fewer if there are fewer."""
    rows, own, w = _cut(df, by, order, chunk)
    behind = F.row_number().over(Window.partitionBy(*own).orderBy(*(F.col(c).desc() for c in order)))
    ends = rows.withColumn("_behind", behind).where(F.col("_behind") <= length)
    tails = ends.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_behind")).alias("p"), F.col(value).alias("v")))), lambda s: s["v"]).alias("_tail"))  # `length` values
    over = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(-length, -1)  # every chunk has a row at least
    all_ = F.flatten(F.collect_list("_tail").over(over))
    return _joined(rows, tails.select(*own, F.slice(all_, F.greatest(F.lit(1), F.size(all_) - length + 1), length).alias(name)), own)


def persistent(df: DataFrame, by: list[str], order: list[str], hit: str, n: int, m: int, chunk: Column, name: str, now_too: bool = False) -> DataFrame:
    """df with windows.persistent as `name`: at least n of the last m rows hit."""
    flag = F.coalesce(F.col(hit), F.lit(False)).cast("int")
    rows = with_tail(df.withColumn("_hit", flag), by, order, "_hit", max(1, m - 1), chunk, "_tail")
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    here = F.sum("_hit").over(w.rowsBetween(-(m - 1), 0))
    missing = F.greatest(F.lit(0), m - F.row_number().over(w))  # so many of the m rows are before the chunk
    size = F.size("_tail")
    before = F.aggregate(F.slice("_tail", F.greatest(F.lit(1), size - F.col("_missing") + 1), F.least(size, F.col("_missing"))), F.lit(0), lambda a, x: a + x)
    out = rows.withColumns({"_here": here, "_missing": missing}).withColumn(name, F.col("_here") + before >= n)
    if now_too:
        out = out.withColumn(name, F.col(name) & (F.col("_hit") == 1))
    return out.drop("_hit", "_tail", "_here", "_missing", CHUNK)


def rising_edges(df: DataFrame, by: list[str], order: list[str], flag: str, chunk: Column, name: str) -> DataFrame:
    """df with windows.rising_edge as `name`."""
    rows = with_tail(df, by, order, flag, 1, chunk, "_tail")
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    before = F.when(F.row_number().over(w) == 1, F.get("_tail", F.lit(0))).otherwise(F.lag(flag).over(w))
    return rows.withColumn("_before", before).withColumn(name, F.col(flag) & ~F.coalesce("_before", F.lit(False))).drop("_tail", "_before", CHUNK)
