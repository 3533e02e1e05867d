"""Live operators with typed state: batch twins against plain code, streams of three files against their batch twins, state that is gone at the end."""

import random

import pytest
from pyspark.sql import functions as F

from watchplan.operators import windows as W
from watchplan.sources import readers, writers
from watchplan.streaming import gates
from watchplan.streaming import processors as P

DETECTIONS = "camera long, frame long, det long, x1 double, y1 double, x2 double, y2 double, at double"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, df, tmp_path, cuts, order="at", extra=None):
    """A file stream of df in files cut at the given times, one file a batch, and a last file that moves the watermark."""
    lows = [float("-inf"), *cuts]
    where = str(tmp_path / "in")
    for lo, hi in zip(lows, [*cuts, float("inf")], strict=True):
        df.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(where)
    if extra is not None:
        extra.coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)


def drained(stream, tmp_path, name="out"):
    spark, out = stream.sparkSession, str(tmp_path / name)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(out)


def state_left(spark, tmp_path, variable, name="out"):
    return spark.read.format("statestore").option("path", str(tmp_path / f"{name}-c")).option("stateVarName", variable).load()


def moving_boxes(seed=1, cameras=2, frames=40):
    rng, rows, det = random.Random(seed), [], 0
    for camera in range(cameras):
        things = [[rng.uniform(0, 200), rng.uniform(0, 100)] for _ in range(4)]
        for frame in range(frames):
            if rng.random() < 0.1:
                continue  # a frame without detections
            for t in things:
                t[0] += rng.uniform(-6, 6)
                t[1] += rng.uniform(-6, 6)
                if rng.random() < 0.75:
                    det += 1
                    rows.append((camera, frame, det, t[0], t[1], t[0] + 30, t[1] + 40, 1.7e9 + frame))
    return rows


def plain_tracks(rows, least, most_missed):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        every = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / every if every > 0 else 0

    out = []
    for camera in {r[0] for r in rows}:
        by_frame = {}
        for r in rows:
            if r[0] == camera:
                by_frame.setdefault(r[1], []).append((r[2], r[3:7]))
        open_, following = [], 1
        for frame in range(min(by_frame), max(by_frame) + 1):
            found = sorted(by_frame.get(frame, []))
            used = set()
            for t in open_:
                best, which = 0.0, None
                for d, box in found:
                    if d not in used and iou(t["box"], box) > best:
                        best, which = iou(t["box"], box), (d, box)
                if which and best >= least:
                    used.add(which[0])
                    t["box"], t["missed"] = which[1], 0
                    out.append((camera, frame, which[0], t["id"]))
                else:
                    t["missed"] += 1
            open_ = [t for t in open_ if t["missed"] <= most_missed]
            for d, box in found:
                if d not in used:
                    open_.append({"id": following, "box": box, "missed": 0})
                    out.append((camera, frame, d, following))
                    following += 1
    return sorted(out)


@pytest.mark.parametrize(("least", "most_missed"), [(0.3, 8), (0.5, 1), (0.3, 0)])
def test_tracks_against_plain_code(spark, least, most_missed):
    rows = moving_boxes()
    got = P.tracks(spark.createDataFrame(rows, DETECTIONS).repartition(3), P.Tracker(least, most_missed))
    assert sorted(map(tuple, got.collect())) == plain_tracks(rows, least, most_missed)


def test_the_track_chooses(spark):
    """The older track takes the box that overlaps it most, though another box comes first; what is left begins a track."""
    rows = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.0), (1, 1, 2, 4.0, 0.0, 14.0, 10.0, 1.0), (1, 1, 3, 1.0, 0.0, 11.0, 10.0, 1.0)]
    got = P.tracks(spark.createDataFrame(rows, DETECTIONS), P.Tracker()).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, 1), (1, 1, 2, 2), (1, 1, 3, 1)]


def test_live_tracks_equal_their_batch_twin(spark, tmp_path):
    rows = moving_boxes()
    df, tracker = spark.createDataFrame(rows, DETECTIONS), P.Tracker(0.3, 2)
    # the second cut is within a frame: its detections come in two batches
    last = spark.createDataFrame([(99, 0, 0, 0.0, 0.0, 1.0, 1.0, 1.7e9 + 5000)], DETECTIONS)
    middle = [r for r in rows if r[1] == 20]
    cut_in_frame = df.withColumn("at", F.when(F.col("det") == middle[-1][2], F.col("at") + 0.5).otherwise(F.col("at")))
    stream = streamed(spark, cut_in_frame, tmp_path, [1.7e9 + 12, 1.7e9 + 20.5], extra=last)
    got = drained(P.live_tracks(stream, tracker, "10 seconds"), tmp_path)
    want = sorted(map(tuple, P.tracks(df, tracker).collect()))
    assert sorted(map(tuple, got.where("camera <> 99").collect())) == want
    left = state_left(spark, tmp_path, "at").select("key.*").distinct().collect()
    assert [r[0] for r in left] == [99]  # the other cameras' state is gone
    assert state_left(spark, tmp_path, "newest").select("key.*").distinct().count() == 1


def test_live_dedup_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 2, 1.7e9 + k * 0.7, k, [float(rng.randint(0, 3)), float(rng.randint(0, 3)), 0.5]) for k in range(60)]
    df = spark.createDataFrame(rows, "camera long, at double, id long, v array<double>")
    recent = gates.Recent(ttl=3.0, least=0.95, most=4)
    last = spark.createDataFrame([(9, 1.7e9 + 900, 999, [1.0, 0.0, 0.0])], df.schema)
    got = drained(P.live_deduplicated(streamed(spark, df, tmp_path, [1.7e9 + 15, 1.7e9 + 30], extra=last), recent), tmp_path)
    want = gates.deduplicated(df, recent, "camera", "at", "v", "id")
    key = lambda d: sorted((r["camera"], r["id"]) for r in d.collect())
    assert key(got.where("camera <> 9")) == key(want) and 0 < want.count() < 60
    assert [r[0] for r in state_left(spark, tmp_path, "held").select("key.*").distinct().collect()] == [9]


def test_a_vector_is_remembered_up_to_its_last_second():
    r = gates.Recent(ttl=3.0, least=0.9)
    held, first = r.step([], 0.0, [1.0, 0.0])
    assert first and not r.step(held, 3.0, [1.0, 0.0])[1] and r.step(held, 3.01, [1.0, 0.0])[1]


def test_live_debounce_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(4)
    rows = [("ab"[k % 2], 1.7e9 + k, k, rng.random() < 0.6) for k in range(90)]
    df = spark.createDataFrame(rows, "track string, at double, id long, hit boolean")
    last = spark.createDataFrame([("z", 1.7e9 + 900, 999, False)], df.schema)
    got = drained(P.live_debounced(streamed(spark, df, tmp_path, [1.7e9 + 31, 1.7e9 + 62], extra=last), 3), tmp_path)
    want = W.debounced(df, ["track"], ["at", "id"], "hit", 3, "id", "track string")
    key = lambda d: sorted((r["track"], r["id"]) for r in d.collect())
    assert key(got) == key(want) and want.count() > 4
    assert [r[0] for r in state_left(spark, tmp_path, "count").select("key.*").distinct().collect()] == ["z"]


RULES, EVENTS = "camera_id long, at double, rule_id long, threshold long, seconds double", "camera_id long, at double"


def alert_rows(spark):
    """Ten events within 30 seconds, then some in each of three parts; the rule is changed between the second and the third."""
    times = [*range(0, 30, 3), 100, 101, 102, 103, 104, 105, 106, 200, 201, 202, 203, 320, 321, 322, 323]
    events = spark.createDataFrame([(c, 1.7e9 + t + c / 10) for t in times for c in (1, 2)], EVENTS)
    rules = spark.createDataFrame([(None, 1.7e9 - 5, 1, 5, 30.0), (2, 1.7e9 + 180, 1, 2, 30.0), (2, 1.7e9 + 300, 1, None, None)], RULES)
    cameras = spark.createDataFrame([(1,), (2,), (3,)], "camera_id long")
    return events, rules, cameras


def test_alerts_by_rules_that_change(spark):
    got = P.alerts(P.changes_and_events(*alert_rows(spark)), P.Frequency(quiet=60.0)).collect()
    assert sorted((r.camera_id, round(r["at"] - 1.7e9), r.n, r.threshold) for r in got) == [(1, 15, 6, 5), (1, 105, 6, 5), (2, 15, 6, 5), (2, 105, 6, 5), (2, 202, 3, 2)]
    assert got[0].text.startswith("High frequency access: 6 attempts in 30s (threshold: 5)")
    with pytest.raises(Exception, match="more than 20"):
        P.alerts(P.changes_and_events(*alert_rows(spark)), P.Frequency(longest=20.0)).collect()


def test_live_alerts_remember_across_batches(spark, tmp_path):
    events, rules, cameras = alert_rows(spark)
    want = sorted(map(tuple, P.alerts(P.changes_and_events(events, rules, cameras), P.Frequency(quiet=60.0)).collect()))
    # cuts within the silence after an alert, and around the change of the rule
    cuts = [1.7e9 + 20, 1.7e9 + 103, 1.7e9 + 150]
    (tmp_path / "r").mkdir()
    (tmp_path / "e").mkdir()
    stream = P.changes_and_events(streamed(spark, events, tmp_path / "e", cuts), streamed(spark, rules, tmp_path / "r", cuts), cameras)
    live = P.live_alerts(stream, P.Frequency(quiet=60.0), "5 minutes")
    table, sent = str(tmp_path / "alerts"), []
    put = writers.two_sinks(table, lambda values, epoch: sent.append((epoch, [r["value"] for r in values.collect()])))
    q = live.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    stored = spark.read.parquet(table)
    assert sorted(map(tuple, stored.select(*[c.split()[0] for c in P.ALERTS.split(", ")]).collect())) == want
    assert sum(len(v) for _, v in sent) == len(want)
    assert len({e for e, v in sent if v}) > 1


def test_a_batch_that_comes_again_is_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 0.0, 6, 5, "x")], P.ALERTS)
    put = writers.two_sinks(str(tmp_path / "t"), lambda values, epoch: values.count())
    for epoch in (0, 0, 1):
        put(df, epoch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_rules_as_they_stand(spark):
    _, rules, _ = alert_rows(spark)
    assert sorted((r.camera_id or 0, r.threshold, r.version) for r in P.latest_rules(rules).collect()) == [(0, 5, 1), (2, None, 2)]


def test_rejected_rows_alone_wait(spark, tmp_path):
    seen = []

    def send(rows, epoch):
        seen.append(sorted(r["event_id"] for r in rows.collect()))
        return rows.where("event_id = 'b'") if epoch == 0 else None

    put = writers.spilling(send, str(tmp_path / "spill"), "event_id")
    put(spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "event_id string, value int"), 0)
    assert [r["event_id"] for r in writers.spilled(spark, str(tmp_path / "spill")).collect()] == ["b"]
    put(spark.createDataFrame([("c", 3), ("b", 2), ("a", 1)], "event_id string, value int"), 1)
    assert seen == [["a", "b"], ["b"], ["c"]] and writers.spilled(spark, str(tmp_path / "spill")).isEmpty()


def test_spill_and_replay(spark, tmp_path):
    """A sink that fails in its second batch loses nothing and, by event id, doubles nothing."""
    taken, calls = {}, []

    def send(rows, epoch):
        calls.append(epoch)
        some = rows.collect()
        if calls.count(epoch) == 1 and epoch == 1:
            raise ConnectionError("no broker")
        for r in some:
            assert r["event_id"] not in taken
            taken[r["event_id"]] = r["value"]

    put = writers.spilling(send, str(tmp_path / "spill"), "event_id")
    for epoch in range(3):
        put(spark.createDataFrame([(f"{epoch}-{k}", f"v{k}") for k in range(4)], "event_id string, value string"), epoch)
        assert writers.spilled(spark, str(tmp_path / "spill")).count() == (4 if epoch == 1 else 0)
    assert len(taken) == 12 and calls == [0, 1, 2, 2]  # the spilled rows first
    put(spark.createDataFrame([("2-0", "v0"), ("3-0", "v0")], "event_id string, value string"), 2)  # the last batch again
    assert len(taken) == 13
