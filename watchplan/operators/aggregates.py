"""Aggregates of the catalogue: zero-filled histograms, rates, percentiles, sweeps, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchplan.operators.joins import small
from watchplan.operators.quantiles import with_percentiles


def domain(spark: SparkSession, column: str, values: list) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))


def zero_filled(counts: DataFrame, spark: SparkSession, column: str, values: list) -> DataFrame:
    """counts with a row for every value of a fixed domain; missing numbers are 0."""
    out = domain(spark, column, values).join(F.broadcast(counts.where(F.col(column).isin(values))), column, "left")
    return out.select(column, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != column))


def histogram(df: DataFrame, bucket: Column, name: str, by: str, values: list[str]) -> DataFrame:
    """Counts by bucket, a column for each value of `by` (conditional counts: one pass, no pivot of distinct values)."""
    return df.groupBy(bucket.alias(name)).agg(*(F.count_if(F.col(by) == v).alias(v) for v in values))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half to even; 0 where there is nothing."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole)), F.lit(0.0)).cast("long")


def percentile_key(point: float) -> str:
    return f"p{point:g}".replace(".", "_")


def sweep(df: DataFrame, by: list[str], track: list[str], order: list[str], column: str, thresholds: DataFrame) -> DataFrame:
    """For each threshold (by, point, threshold): rows, hits, rate in percent, longest run of hits within a track.

    Thresholds (points x groups) are broadcast if they are few; rows are ordered within tracks, never as a whole.
    """
    thresholds = small(thresholds)
    rows = df.join(thresholds, by) if by else df.crossJoin(thresholds)
    rows = rows.withColumn("hit", F.col(column) > F.col("threshold"))
    w = Window.partitionBy(*by, "point", *track).orderBy(*order)
    runs = rows.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "point", *track, "hit").orderBy(*order)))
    per = runs.groupBy(*by, "point", "threshold", *track, "hit", "run").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by, "point", "threshold").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"),
        F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("longest"),
    ).withColumn("rate", F.col("hits") * 100.0 / F.col("rows"))


def confusion(df: DataFrame, truth: Column, guess: Column, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn and what follows from them; 0 where a ratio has no denominator."""
    n = df.groupBy(*(by or [])).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & ~guess).alias("tn"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.select("*", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(tn, tn + fp).alias("specificity"), over(fp, fp + tn).alias("fpr"), over(fn, fn + tp).alias("fnr"), over(tp + tn, tp + tn + fp + fn).alias("accuracy"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ranking_quality(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """AUROC (ties count half) and average precision for each group of `by`.

    Rows are first summed by distinct score, so that the ordered sums run over scores, not rows.
    """
    n = df.groupBy(*by, score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((~F.col(truth)).cast("long")).alias("q"))
    down = Window.partitionBy(*by).orderBy(F.col(score).desc())
    up = down.rowsBetween(Window.unboundedPreceding, 0)
    r = n.select(*by, "p", "q", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"))
    agg = r.groupBy(*by).agg(
        F.sum(F.col("p") * (F.lit(0) - F.col("fp") + F.col("q") / 2)).alias("a"), F.sum("p").alias("np"), F.sum("q").alias("nq"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    return agg.select(*by, F.try_divide(F.col("a") + F.col("np") * F.col("nq"), F.col("np") * F.col("nq")).alias("auroc"), F.try_divide("ap", "np").alias("average_precision"))


def ks_distance(df: DataFrame, sample: Column, column: str, by: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic between rows where sample holds and the others, per group; null if either has none."""
    n = df.groupBy(*by, column).agg(F.count_if(sample).alias("a"), F.count_if(~sample).alias("b"))
    up = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    share = lambda c: F.try_divide(F.sum(c).over(up), F.sum(c).over(every))
    gap = F.abs(share("a") - share("b"))
    return n.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"))


def abs_correlation(x: str, y: str) -> Column:
    """|Pearson|; null below three rows or without variance."""
    enough = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(enough, F.abs(F.corr(x, y)))


def described(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, count, mean, std (sample), std0 (population), min, q1, q2, q3, max of each group; quartiles are exact, whatever a group's size."""
    sums = df.groupBy(*by).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.stddev_pop(column).alias("std0"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = with_percentiles(sums, df, by, column, {"q1": 25.0, "q2": 50.0, "q3": 75.0})
    return out.select(*by, "count", "mean", "std", "std0", "min", "q1", "q2", "q3", "max")
