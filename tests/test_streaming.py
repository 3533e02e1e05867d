"""Streams over files against their batch twins; sources and sinks on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchplan.sources import readers, writers
from watchplan.streaming import alerts, gates

GATE = gates.Gate(threshold=1.0, sigma=1.0, n=2, m=3, cooldown=4.0)


def rows(spark):
    score = [0, 2, 3, 3, 0, 0, 0, 4, 4, 4, 0, 0, 3, 3, 3]
    return spark.createDataFrame([(t, k, 1.7e9 + k, float(s if t == "a" else 1.5 * s)) for t in "ab" for k, s in enumerate(score)], "track string, seq long, at double, score double")


def drained(stream, tmp_path, name, mode="append"):
    spark = stream.sparkSession
    out = str(tmp_path / name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(out)


def three_files(spark, df, tmp_path):
    for part in range(3):  # three files, three batches
        df.where((F.col("seq") >= 5 * part) & (F.col("seq") < 5 * part + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return readers.files(spark, str(tmp_path / "in"), df.schema)


def test_live_gate_equals_its_batch_twin(spark, tmp_path):
    df = rows(spark)
    live = drained(gates.live(three_files(spark, df, tmp_path), GATE), tmp_path, "live")
    key = lambda d: sorted((r["track"], r["seq"], round(r["smooth"], 9), r["lasting"], r["emits"]) for r in d.collect())
    assert key(live) == key(gates.batch(df, GATE)) and any(r["emits"] for r in live.collect())


def test_live_buffers_equal_their_batch_twins(spark, tmp_path):
    df = rows(spark)
    stream = three_files(spark, df, tmp_path)
    key = lambda d, c: sorted((r["track"], r["seq"], list(r[c])) for r in d.collect())
    windows = gates.Tubelets(length=4, stride=3)
    want = key(gates.tubelets(df, windows), "scores")
    assert key(drained(gates.live_tubelets(stream, windows), tmp_path, "tubelets"), "scores") == want and [s for t, s, _ in want if t == "a"] == [3, 6, 9, 12]
    want = key(gates.frame_buffers(df, 3, "score >= 4"), "frames")
    assert key(drained(gates.live_frame_buffers(stream, 3, 4.0), tmp_path, "frames"), "frames") == want and ("a", 7, [5, 6, 7]) in want


def test_edge_counts_while_cooldown_holds_it_back():
    g = gates.Gate(threshold=0.5, sigma=0, n=1, m=1, cooldown=10.0)
    state, emits = g.fresh(), []
    for k, s in enumerate([1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1]):
        state, (_, _, e) = g.step(state, float(k), float(s))
        emits.append(e)
    assert [k for k, e in enumerate(emits) if e] == [0, 11]


def test_a_gap_empties_the_buffer_and_not_the_gate():
    """A track that comes back 77 samples after its last one was dropped at the sample before; after 76 it wasn't."""
    w = gates.Tubelets(length=2, stride=1)
    assert w.step(w.step(w.fresh(), 0, 1.0)[0], 76, 2.0)[1] == [1.0, 2.0] and w.step(w.step(w.fresh(), 0, 1.0)[0], 77, 2.0)[1] is None
    g = gates.Gate(threshold=0.5, sigma=0, n=2, m=3, cooldown=0.0)
    state, _ = g.step(g.fresh(), 0.0, 1.0)
    assert g.step(state, 1000.0, 1.0)[1][1]


def test_scores_that_are_no_numbers_count_as_nothing():
    g = gates.Gate(threshold=0.5, sigma=0)
    assert [g.step(g.fresh(), 0.0, x)[1][0] for x in (float("nan"), float("inf"), None, 2.0)] == [0.0, 0.0, 0.0, 2.0]


def test_windows_by_stride_of_the_index():
    w = gates.Tubelets(length=3, stride=4)
    state, out = w.fresh(), []
    for seq in (0, 2, 4, 6, 8, 9):
        state, made = w.step(state, seq, float(seq))
        if made:
            out.append((seq, made))
    assert out == [(4, [0.0, 2.0, 4.0]), (8, [4.0, 6.0, 8.0])]


def test_ttl_dedup_is_not_renewed_by_a_hit():
    r, held, out = gates.Recent(), [], []
    for t in (0.0, 2.9, 3.1):
        held, new = r.step(held, t, [1.0, 0.0])
        out.append(new)
    assert out == [True, False, True]


def test_frequency_alerts_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, f"2024-01-01 00:00:{s:02d}") for s in range(10)] + [(2, "2024-01-01 00:00:05"), (9, "2024-01-01 01:00:00")], "camera_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    rules = spark.createDataFrame([(7, 1, 5), (8, None, 50)], "rule_id int, camera_id long, threshold long")
    kw = {"length": "60 seconds", "slide": "60 seconds", "late": "1 minute"}
    batch = alerts.frequency_alerts(e, rules, **kw)
    assert [(r["camera_id"], r["n"], r["rule_id"]) for r in batch.collect()] == [(1, 10, 7)] and "threshold: 5" in batch.first()["text"]
    got = drained(alerts.frequency_alerts(readers.files(spark, str(tmp_path / "e"), e.schema), rules, **kw), tmp_path, "a")
    assert [(r["camera_id"], r["n"]) for r in got.collect()] == [(1, 10)]
    calm = alerts.suppressed(spark.createDataFrame([(1, s) for s in (0, 10, 40, 65)], "camera_id long, s long").withColumn("ts", F.timestamp_seconds("s")), ["camera_id"], "ts", 30.0)
    assert [r["second"] for r in calm.orderBy("second").collect()] == [0.0, 40.0]


def test_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿video_id,label\nclip_2,1\nclip_10,x\n", encoding="utf-8")
    schema = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("label", T.IntegerType())])
    got = readers.csv(spark, str(tmp_path / "l.csv"), schema)
    assert [tuple(r) for r in got.orderBy(readers.natural_key(F.col("video_id"))).collect()] == [("clip_2", 1), ("clip_10", None)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    j = readers.jsonl(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())])).cache()
    assert j.count() == 2 and j.where("_bad is not null").count() == 1
    np.save(tmp_path / "m.npy", np.arange(6).reshape(3, 2))
    assert [list(r["v"]) for r in readers.matrices(spark, str(tmp_path)).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "c.json").write_text('{"recommended": {"threshold": 0.3}}')
    assert readers.config(spark, str(tmp_path / "c.json"), {"t": ["threshold", "recommended.threshold"], "k": ["k"]}, {"k": 5}) == {"t": 0.3, "k": 5}
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "a.bin").write_bytes(b"face")
    got = readers.objects(spark, ["s3://bucket/a.bin"], f"file://{tmp_path}/")
    assert bytes(got.first()["content"]) == b"face"
    with pytest.raises(ValueError):
        readers.objects(spark, ["http://x/y"])
    assert readers.listing(spark, str(tmp_path), "*.npy").count() == 1
    spark.range(1).createOrReplaceTempView("one_row")
    assert readers.catalog_tables(spark).where("table = 'one_row'").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id long, v double")
    assert [r["v"] for r in writers.sanitised(df).orderBy("id").collect()] == [None, None, 1.5]
    values = {r["key"]: json.loads(r["value"]) for r in writers.kafka_values(df, "id").collect()}
    assert values["1"] == {"id": 1} and values["3"] == {"id": 3, "v": 1.5}
    put = writers.once(str(tmp_path / "t"), "id")
    for epoch in (0, 0, 1):  # the first batch twice, then its rows in another one
        put(df, epoch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    for kind in ("csv", "json", "parquet"):
        writers.report(df, str(tmp_path / kind), kind)
    assert readers.parsed(spark.createDataFrame([("k", '{"event_id": "e", "camera_id": 3}'), ("k", "?")], "key string, value string"), readers.FACE_EVENT).where("event_id is not null").count() == 1


def test_suppressed_samples_leave_the_state_alone(spark, tmp_path):
    df = rows(spark).withColumn("reason", F.when(F.col("seq") % 4 == 2, "low_confidence"))
    got = {(r["track"], r["seq"]): r for r in gates.guarded(df, GATE).collect()}
    kept = {(r["track"], r["seq"]): r for r in gates.batch(df.where("reason IS NULL"), GATE).collect()}
    score = {(r["track"], r["seq"]): r["score"] for r in df.collect()}
    for key, r in got.items():
        if key in kept:
            assert (r["smooth"], r["lasting"], r["emits"], r["reason"]) == (kept[key]["smooth"], kept[key]["lasting"], kept[key]["emits"], None)
        else:
            assert (r["smooth"], r["lasting"], r["emits"], r["reason"]) == (score[key], False, False, "low_confidence")
    with_all = {(r["track"], r["seq"]): r["smooth"] for r in gates.batch(df, GATE).collect()}
    assert any(with_all[k] != r["smooth"] for k, r in kept.items())  # they would have counted
    live = drained(gates.live_guarded(three_files(spark, df, tmp_path), GATE), tmp_path, "guarded")
    assert {(r["track"], r["seq"]): tuple(r) for r in live.collect()} == {k: tuple(r) for k, r in got.items()}


def test_heartbeat_of_a_live_query(spark, tmp_path):
    import time

    from watchplan.streaming import heartbeat

    df = rows(spark)
    stream = heartbeat.observed(three_files(spark, df, tmp_path))
    listener = heartbeat.Heartbeats()
    spark.streams.addListener(listener)
    try:
        q = stream.writeStream.queryName("camera-1").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for _ in range(100):  # events come by a thread of their own
            if listener.beats().get("camera-1", heartbeat.Beat()).ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    beat = listener.beats()["camera-1"]
    want = gates.heartbeat(df.withColumn("all", F.lit(1)), "all").first()
    assert (beat.samples, beat.first, beat.last, beat.batches, beat.error) == (want["samples"], want["first"], want["last"], 3, None)
    assert beat.fps == pytest.approx(want["fps"]) and beat.ended
    assert beat.after(beat.newest, 99, 0.0, 9e9) == beat  # a batch that is reported again
    assert heartbeat.Beat().fps is None and heartbeat.Beat().after(0, 1, 5.0, 5.0).fps is None


def test_silent_sessions():
    from watchplan.streaming import heartbeat

    h = heartbeat.Heartbeats()
    h._beats = {"a": heartbeat.Beat(samples=1, last=10.0), "b": heartbeat.Beat(samples=1, last=99.0), "c": heartbeat.Beat(), "d": heartbeat.Beat(last=1.0, ended=True)}
    assert h.stale(100.0, 30.0) == ["a", "c"]
