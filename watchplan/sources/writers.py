"""Sinks: reports, JSON without NaN, Kafka values, once-only batches, two sinks of one batch, spill and replay."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchplan.functions.text import finite


def sanitised(df: DataFrame) -> DataFrame:
    """Floating columns with null for NaN and infinities."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def report(df: DataFrame, path: str, kind: str) -> None:
    """csv (with header), json (lines) or parquet; one folder, a file per task."""
    w = sanitised(df).write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[kind]()


def kafka_values(df: DataFrame, key: str) -> DataFrame:
    """key and value (JSON without null fields) for a Kafka sink."""
    clean = sanitised(df)
    return clean.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "true"}).alias("value"))


def once(path: str, key: str):
    """A foreachBatch function that keeps rows whose key no other batch has; each batch has a partition of its own.

    A batch that is repeated writes its partition anew, so that a failure half way leaves nothing twice; of the target only
    the keys are read.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            held = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != epoch).select(key)
            new = new.join(held, key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return put


def two_sinks(table: str, send: Callable[[DataFrame, int], object], key: str = "camera_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores each batch in table and sends it as kafka_values.

    A batch that is repeated replaces its own partition; what is sent is read from there, so that both sinks have
    the same rows, computed once.  Sending is at least once.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        where = f"{table}/batch={epoch}"
        batch.write.mode("overwrite").parquet(where)
        send(kafka_values(batch.sparkSession.read.schema(batch.schema).parquet(where), key), epoch)

    return put


def spilled(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows that wait in the spill table of spilling(); None before any batch."""
    waiting, sent = _read(spark, f"{path}/waiting"), _read(spark, f"{path}/sent")
    if waiting is None or sent is None:
        return waiting
    return waiting.join(sent.select(F.col(sent.columns[0]).alias("_sent")), F.col(sent.columns[0]) == F.col("_sent"), "left_anti")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.option("basePath", path).parquet(path) if files.exists(target) else None


def spilling(send: Callable[[DataFrame, int], DataFrame | None], path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends each batch, and first what earlier batches could not.

    send gives the rows that were rejected, or None if none were; if it raises, all are.  Rejected rows wait in path/waiting, a
    partition for each batch; the keys of what was sent are in path/sent.  No row is lost, as it is written before it is sent; a key
    that was sent isn't sent again, whichever batch it comes in, unless the job ends between sending and noting it.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        waiting, sent = spilled(spark, path), _read(spark, f"{path}/sent")
        if waiting is not None:
            waiting = waiting.where(F.col("batch") != epoch).drop("batch").dropDuplicates([key]).select(*batch.columns)
            new = new.join(waiting.select(key), key, "left_anti").select(*batch.columns)
        if sent is not None:
            new = new.join(sent.select(key), key, "left_anti").select(*batch.columns)
        mine = f"{path}/waiting/batch={epoch}"
        rows = new.withColumn("_old", F.lit(False)) if waiting is None else new.withColumn("_old", F.lit(False)).unionByName(waiting.withColumn("_old", F.lit(True)))
        staged = f"{path}/staged/batch={epoch}"
        rows.write.mode("overwrite").partitionBy("_old").parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
        rows.drop("_old").write.mode("overwrite").parquet(mine)
        done = []
        for old in (True, False):
            some = rows.where(F.col("_old") == old).drop("_old")
            if some.isEmpty():
                continue
            try:
                rejected = send(some, epoch)
            except Exception:  # whatever the sink says: the rows wait, and the next batch tries again
                logging.getLogger(__name__).exception("batch %s was rejected", epoch)
                continue
            done.append(some.select(key) if rejected is None else some.select(key).join(rejected.select(key), key, "left_anti"))
        if done:
            noted = done[0] if len(done) == 1 else done[0].unionByName(done[1])
            noted.write.mode("append").parquet(f"{path}/sent/batch={epoch}")

    return put
