"""Sources: tables, CSV with a byte order mark, JSON lines, matrices, configs, listings, Kafka and file streams."""

from __future__ import annotations

import io
import json
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Recognition events as they come from the edge.
FACE_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("camera_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("event_type", T.StringType()),
    T.StructField("quality_score", T.DoubleType()), T.StructField("processing_time_ms", T.LongType()), T.StructField("model_version", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("evidence_ref", T.StringType()),
])


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is no part of it."""
    names = spark.read.option("header", True).csv(path).columns
    df = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    df = df.toDF(*(n.lstrip("﻿") for n in names))
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; lines that can't be read are kept in _bad."""
    return spark.read.schema(T.StructType([*schema, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """Rows of .npy files as (path, row, v); files are read where their bytes are, in tasks."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"path": p, "row": np.arange(len(m)), "v": list(m.astype(float))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "path string, row long, v array<double>")


def config(spark: SparkSession, path: str, keys: dict[str, list[str]], default: dict | None = None) -> dict:
    """Values of a small JSON file; each under the first of its names that is there ('a.b' goes down)."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).limit(1).collect())
    data = json.loads(text)

    def look(name: str):
        return reduce(lambda at, k: at.get(k) if isinstance(at, dict) else None, name.split("."), data)

    return {k: next((v for n in names if (v := look(n)) is not None), (default or {}).get(k)) for k, names in keys.items()}


def catalog_tables(spark: SparkSession) -> DataFrame:
    """Tables and columns of the session's catalog."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below path in natural order of the numbers in their names; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.orderBy(natural_key(F.col("path")), "path")


def objects(spark: SparkSession, references: list[str], root: str = "s3a://", most: int = 10_000) -> DataFrame:
    """(path, length, content) of objects by reference (s3://bucket/key); root takes the place of s3://.

    References are named one by one, so nothing else is listed or read; more than `most` are an error (join a listing instead).
    """
    if len(references) > most:
        raise ValueError(f"{len(references)} references, more than {most}")
    bad = [r for r in references if not re.fullmatch(r"s3://[^/]+/.+", r)]
    if bad:
        raise ValueError(f"no references: {bad[:3]}")
    return spark.read.format("binaryFile").load([root + r.removeprefix("s3://") for r in references]).select("path", "length", "content")


def natural_key(c: Column) -> Column:
    """Sorts 'clip_2' before 'clip_10': numbers are padded."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType = FACE_EVENT, group: str = "watchplan") -> DataFrame:
    """A stream of JSON values; offsets are kept by the query's checkpoint, so a batch counts once it has succeeded."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").option("groupIdPrefix", group).load()
    return parsed(raw, schema)


def files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Key and fields of JSON values; values that are no JSON are dropped."""
    return raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("v")).where("v is not null").select("key", "v.*")
