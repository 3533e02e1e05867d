"""Percentiles of groups, and ordered operators on tracks, that are larger than a task."""

import random

import pytest
from pyspark.sql import functions as F

from watchplan.operators import aggregates, chunks, quantiles
from watchplan.operators import windows as W

POINTS = [0.0, 12.5, 50.0, 90.0, 99.9, 100.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [("wide", rng.gauss(0, 1) * 10 ** rng.randint(-5, 5)) for _ in range(3000)] + [("equal", 7.25)] * 900 + [("two", float(k % 2)) for k in range(801)] + [("ties", float(rng.randint(0, 9))) for _ in range(1000)]
    rows += [("small", float(k)) for k in range(11)] + [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None), ("none", float("nan")), ("wide", float("inf")), ("wide", None), ("edge", -1.7e308), ("edge", 1.7e308)] + [("edge", float(k)) for k in range(200)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize(("held", "cells"), [(10**6, 512), (60, 8), (5, 3), (1, 2)])
def test_percentiles_whatever_is_held(spark, values, held, cells):
    fine = values.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf')")
    want = {(r.g, p): x for r in fine.groupBy("g").agg(F.percentile("v", F.array(*(F.lit(p / 100) for p in POINTS))).alias("x")).collect() for p, x in zip(POINTS, r.x)}
    got = {(r.g, r.point): r.threshold for r in quantiles.percentiles(values, ["g"], "v", POINTS, held, cells).collect()}
    assert set(got) == set(want) and ("none", 50.0) not in got
    for key, x in want.items():
        assert got[key] == pytest.approx(x, rel=1e-12, abs=1e-300), key


def test_percentiles_of_all_rows_and_of_none(spark, values):
    ties = values.where("g = 'ties'")
    want = ties.agg(F.percentile("v", 0.9)).first()[0]
    assert [r.threshold for r in quantiles.percentiles(ties, [], "v", [90.0], held=20, cells=4).collect()] == [want]
    assert quantiles.percentiles(values.where("false"), ["g"], "v", [50.0]).collect() == []
    assert quantiles.percentiles(values.where("false"), [], "v", [50.0]).collect() == []
    assert aggregates.described(ties, ["g"], "v").first()["q2"] == ties.agg(F.percentile("v", 0.5)).first()[0]


def test_a_group_ten_times_as_large_holds_no_more(spark, monkeypatch):
    """What is sorted at the end is a cell of at most `held` values, or one value many times over, which is not sorted at all."""
    sizes = []
    keep = quantiles._within

    def within(rows, state, by, names):
        sizes.append(state.where("_in <= 50").agg(F.max("_in")).first()[0])
        return keep(rows, state, by, names)

    monkeypatch.setattr(quantiles, "_within", within)
    for n in (2_000, 20_000):
        df = spark.range(n).select(F.lit("g").alias("g"), (F.rand(3) * 1000).alias("v"))
        df = spark.createDataFrame(df.collect(), df.schema)
        want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
        got = sorted((r.point, r.threshold) for r in quantiles.percentiles(df, ["g"], "v", [50.0, 95.0], held=50, cells=16).collect())
        assert [x for _, x in got] == pytest.approx(want)
        assert (sizes[-1] or 0) <= 50


def random_tracks(spark, seed):
    rng, rows = random.Random(seed), []
    for g in ("a", "b", None):
        t = 0.0
        for k in range(rng.randint(60, 120)):
            t += rng.choice([0.0, 1.0, 1.0, 2.0, 7.0, 30.0])
            rows.append((g, t, k, rng.random() < 0.6 if rng.random() < 0.95 else None, rng.random()))
    return spark.createDataFrame(rows, "g string, t double, k long, hit boolean, v double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).repartition(4)


@pytest.mark.parametrize("seconds", [1.0, 20.0])
def test_chunks_change_nothing(spark, seconds):
    df, by, order, chunk = random_tracks(spark, int(seconds)), ["g"], ["t", "k"], chunks.by_time("ts", seconds)
    said = df.withColumn("hit", F.coalesce("hit", F.lit(False)))
    rows = lambda d, *c: sorted((tuple(r) for r in d.select(*c).collect()), key=repr)
    assert rows(chunks.longest_run(said, by, order, "hit", chunk), "g", "longest") == rows(W.longest_run(said, by, order, "hit"), "g", "longest")
    for gap in (0.0, 1.5, 6.9, 1e9):
        columns = ["g", "session", "start", "end", "rows", "top", F.round("mean", 9)]
        assert rows(chunks.gap_sessions(df, by, order, "ts", gap, "v", chunk), *columns) == rows(W.gap_sessions(df, by, order, "ts", gap, "v"), *columns)
    for n, m, now_too in ((3, 5, False), (1, 1, False), (2, 9, True), (4, 4, True)):
        want = df.withColumn("p", F.coalesce(W.persistent(F.coalesce("hit", F.lit(False)), W.track(by, order), n, m, now_too=now_too), F.lit(False)))
        assert rows(chunks.persistent(df, by, order, "hit", n, m, chunk, "p", now_too), "g", "k", "p") == rows(want, "g", "k", "p")
    assert rows(chunks.rising_edges(said, by, order, "hit", chunk, "r"), "g", "k", "r") == rows(said.withColumn("r", W.rising_edge("hit", W.track(by, order))), "g", "k", "r")


def test_one_track_is_dealt_to_many_tasks(spark):
    """All rows are one track: no task of the windows has more than its share."""
    df = spark.range(4000).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 7 < 5).alias("hit"), F.timestamp_seconds(F.col("id")).alias("ts")).repartition(4)
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = chunks.persistent(df, ["g"], ["ts", "k"], "hit", 3, 5, chunks.by_time("ts", 50.0), "p")
        share = out.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p").cast("int")).alias("s")).agg(F.max("n"), F.count("*"), F.sum("s")).first()  # p must be needed, else the windows are left out
        assert share[0] < 4000 / 4 and share[1] > 8
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    assert chunks.longest_run(df, ["g"], ["ts", "k"], "hit", chunks.by_time("ts", 50.0)).first()["longest"] == 5


def test_chunks_of_nothing(spark):
    none = random_tracks(spark, 1).where("false")
    chunk = chunks.by_time("ts", 5.0)
    assert chunks.longest_run(none, ["g"], ["t"], "hit", chunk).collect() == chunks.gap_sessions(none, ["g"], ["t"], "ts", 1.0, "v", chunk).collect() == []
    assert chunks.persistent(none, ["g"], ["t"], "hit", 1, 2, chunk, "p").collect() == []
