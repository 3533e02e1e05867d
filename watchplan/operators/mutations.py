"""Changes of tables as functions from frames to frames: upsert, claim, expire, prune, insert-if-missing, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], greatest: list[str], latest: list[str]) -> DataFrame:
    """One row per key of old and new together: `greatest` columns keep their maximum, `latest` those of the last row that has a value."""
    every = old.unionByName(new)
    at = F.struct(*order)
    return every.groupBy(*keys).agg(*(F.max(c).alias(c) for c in greatest), *(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in latest), F.count(F.lit(1)).alias("versions"))


def missing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't there yet."""
    return new.join(old.select(*keys), keys, "left_anti")


def claimed(jobs: DataFrame, order: list[Column], workers: int, each: int) -> DataFrame:
    """The first workers * each open jobs in priority order with the worker that takes each.

    Row locks have no counterpart here; a batch is dealt among workers instead.
    """
    top = jobs.orderBy(*order).limit(workers * each).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # bounded by the limit
    return top.withColumn("worker", F.pmod(F.col("_n") - 1, F.lit(workers)).cast("int")).drop("_n")


def expired(df: DataFrame, seen: str, now: Column, after: str) -> Column:
    return F.when(F.col(seen) < now - F.expr(f"INTERVAL {after}"), "lost").otherwise("active")


def pruned(df: DataFrame, by: list[str], prunable: Column, order: list[Column], keep: int) -> DataFrame:
    """All rows that can't be pruned and the first `keep` of the others."""
    n = F.row_number().over(Window.partitionBy(*by, prunable).orderBy(*order))
    return df.withColumn("_n", n).where(~prunable | (F.col("_n") <= keep)).drop("_n")


def requeued(status: Column, attempts: Column, most: int) -> Column:
    return F.when((status == "failed") & (attempts < most), "queued").when(status == "failed", "dead").otherwise(status)


def to_sync(source: DataFrame, target: DataFrame, key: str, tag: str) -> DataFrame:
    """Objects of source that target lacks or has in another version."""
    return source.join(target.select(key, tag), [key, tag], "left_anti")


def numbered(df: DataFrame, order: str, start: Column | int = 0, width: int = 10_000, name: str = "id") -> DataFrame:
    """df with gapless numbers from start + 1 on in the order of an integer column, as an insert that returns its ids gives them.

    Rows are ordered in ranges of `width` values; where a range begins comes from counts, so no task orders all rows.
    """
    placed = df.withColumn("_b", F.floor(F.col(order) / width))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    begin = counts.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))  # a row for each range
    n = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return placed.join(begin, "_b").withColumn(name, (F.col("_begin") + n + start).cast("long")).drop("_b", "_begin")


def inserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The new rows with ids that go on from the greatest of old."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))
    return numbered(new.crossJoin(F.broadcast(top)), order, F.col("_top"), name=key).drop("_top")  # one row


def rules_changed(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules (id, active, ...) after changes (id, op, at): deactivate, reactivate, delete; the last one of an id counts, a deletion for ever.

    A change with a null id is meant for all rules.
    """
    all_ = changes.where("id is null").agg(F.max_by("op", "at").alias("_all"), F.max("at").alias("_all_at"), F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("_gone_at"))
    own = changes.where("id is not null").groupBy("id").agg(F.max_by("op", "at").alias("_op"), F.max("at").alias("_at"), F.bool_or(F.col("op") == "delete").alias("_gone"))
    both = rules.join(own, "id", "left").crossJoin(F.broadcast(all_))  # one row
    last = F.when(F.col("_all_at").isNotNull() & (F.col("_at").isNull() | (F.col("_all_at") > F.col("_at"))), F.col("_all")).otherwise(F.col("_op"))
    kept = both.where(~F.coalesce("_gone", F.lit(False)) & F.col("_gone_at").isNull())
    active = F.when(last == "deactivate", False).when(last == "reactivate", True).otherwise(F.col("active"))
    return kept.withColumn("active", active).select(*rules.columns)


def heartbeats(beats: DataFrame, by: list[str], at: list[str], fields: str) -> DataFrame:
    """A session's beats merged, a later one's fields (a map) over earlier ones': (by, name, value), each field with its last value."""
    each = beats.select(*by, F.struct(*at).alias("_at"), F.explode(fields).alias("name", "value"))
    return each.groupBy(*by, "name").agg(F.max_by("value", "_at").alias("value"))
