"""Ordered operators on small series, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchplan.operators import windows as W

def track():
    return W.track(["g"], ["t"])


def series(spark, values):
    return spark.createDataFrame([("a", k, None if v is None else float(v)) for k, v in enumerate(values)], "g string, t long, v double")


def got(df, column):
    return [r[0] for r in df.orderBy("t").select(column).collect()]


def causal(values, sigma):
    if sigma <= 0:
        return list(values)
    r, out = math.ceil(3 * sigma), []
    for k in range(len(values)):
        w = [(math.exp(-((k - j) ** 2) / (2 * sigma**2)), values[j]) for j in range(max(0, k - r), k + 1) if values[j] is not None]
        out.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
    return out


@pytest.mark.parametrize("sigma", [0, 1, 2])
@pytest.mark.parametrize("values", [[0, 0, 10, 0, 0], [3], [1, 2], [1, None, 4, 9]])
def test_causal_gaussian(spark, values, sigma):
    out = got(series(spark, values).withColumn("s", W.causal_gaussian("v", track(), sigma)), "s")
    for a, b in zip(out, causal(values, sigma), strict=True):
        assert a == b or abs(a - b) < 1e-12


@pytest.mark.parametrize("values", [[0, 0, 10, 0, 0], [3], [1, 2], [5, 1, 4, 9, 2, 2, 8]])
def test_centred_gaussian(spark, values):
    sigma, r = 1.0, 3
    x = np.pad(np.array(values, float), r, mode="edge")
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / 2)
    want = np.convolve(x, w / w.sum(), "valid") if len(values) > 2 else np.array(values, float)
    out = got(series(spark, values).withColumn("s", W.centred_gaussian("v", ["g"], track(), sigma, r)), "s")
    assert np.allclose(out, want)


def test_persistence(spark):
    df = series(spark, [1, 0, 1, 1, 0, 0, 0, 1]).withColumn("h", F.col("v") > 0)
    assert got(df.withColumn("p", W.persistent(F.col("h"), track(), 3, 5)), "p") == [False, False, False, True, True, False, False, False]
    assert got(df.withColumn("p", W.persistent(F.col("h"), track(), 3, 5, now_too=True)), "p") == [False, False, False, True, False, False, False, False]


def test_cooldown_and_sessions(spark):
    df = spark.createDataFrame([("a", k, t, 1.0) for k, t in enumerate([0.0, 3.0, 5.0, 9.9, 10.0])], "g string, id long, at double, v double")
    out = W.cooldown(df, ["g"], ["at", "id"], "at", 5.0, "id", "g string").orderBy("id").collect()
    assert [r["id"] for r in out] == [0, 2, 4]
    s = df.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    assert W.gap_sessions(s, ["g"], ["ts"], "ts", 5.0, "v").count() == 1
    assert W.gap_sessions(s, ["g"], ["ts"], "ts", 2.0, "v").count() == 3


def test_longest_run_rising_edge_segments(spark):
    df = series(spark, [0, 1, 1, 0, 1, 1, 1, 0]).withColumn("h", F.col("v") > 0)
    assert W.longest_run(df, ["g"], ["t"], "h").first()["longest"] == 3
    assert got(df.withColumn("r", W.rising_edge("h", track())), "r") == [False, True, False, False, True, False, False, False]
    none = series(spark, [0, 0]).withColumn("h", F.col("v") > 0)
    assert W.longest_run(none, ["g"], ["t"], "h").first()["longest"] == 0


def test_strides(spark):
    df = series(spark, range(10))
    s = W.strided(df, ["g"], ["t"], 4, 2, ["v"]).orderBy("start_index").collect()
    assert [(r["start_index"], [x["v"] for x in r["rows"]]) for r in s] == [(k, [k, k + 1, k + 2, k + 3]) for k in (0, 2, 4, 6)]
    live = W.strided_by_gap(df.withColumn("at", F.col("t")), ["g"], ["at", "t"], "at", 4, 3, "t", "g string")
    assert sorted(r["t"] for r in live.collect()) == [3, 6, 9]


def test_debounce(spark):
    df = series(spark, [1, 1, 0, 1, 1, 1]).withColumn("h", F.col("v") > 0)
    out = W.debounced(df, ["g"], ["t"], "h", 3, "t", "g string")
    assert [r["t"] for r in out.collect()] == [4]


def test_carried_and_repaired(spark):
    df = series(spark, [None, 1, None, None, None, 7, None])
    assert got(df.withColumn("c", W.carried("v", "t", track(), 2)), "c") == [None, 1, 1, 1, None, 7, 7]
    assert got(df.withColumn("c", W.repaired("v", track())), "c") == [1, 1, 1, 1, 1, 7, 7]


def test_ground_points_fall_back_and_remember_the_fallback(spark):
    """seq, left ankle and its confidence, right ankle and its confidence, middle of the box's lower side."""
    n = None
    rows = [
        (0, n, n, n, n, n, n, 5.0, 9.0), (1, 1.0, 1.0, 0.9, 3.0, 3.0, 0.35, 5.0, 9.0), (2, 1.0, 1.0, 0.34, n, n, 0.9, 6.0, 9.0), (13, n, n, n, n, n, n, 7.0, 9.0), (14, n, n, n, n, n, n, 8.0, 8.0), (26, n, n, n, n, n, n, 8.5, 8.5), (27, n, n, n, n, n, n, 9.0, 7.0), (28, 2.0, 2.0, 0.5, float("nan"), 1.0, 0.9, 9.0, 7.0),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "track long, seq long, lx double, ly double, lconf double, rx double, ry double, rconf double, bx double, by_ double")
    got = [(r["seq"], r["x"], r["y"], r["source"]) for r in W.ground_points(df, ["track"], "seq", "track long").orderBy("seq").collect()]
    assert got == [
        (0, 5.0, 9.0, "bbox_bottom"), (1, 2.0, 2.0, "ankle_midpoint"), (2, 2.0, 2.0, "freeze_last_valid"), (13, 2.0, 2.0, "freeze_last_valid"), (14, 8.0, 8.0, "bbox_bottom"),
        (26, 8.0, 8.0, "freeze_last_valid"), (27, 9.0, 7.0, "bbox_bottom"), (28, 2.0, 2.0, "single_ankle"),
    ]


def test_key_frames_by_gate():
    import numpy as np

    from watchplan.operators import ranking as R

    scores = np.array([0, 0, 5.0, 0, 0, 0, 0, 4.9, 0, 0, 0, 0, 0, 0, 0])
    frames, selector, basis, peaks = R.chosen_frames(" Deep", 16, {"image": scores}, 8)
    assert frames == [0, 2, 3, 4, 7, 8, 9, 15] and (selector, basis, peaks) == ("deep", "image", [3, 8])
    assert R.chosen_frames("deep", 8, {"image": scores}, 8)[:3] == (list(range(8)), "deep", "all_frames")
    assert R.chosen_frames("deep", 0, {}, 8)[0] == []
    still = np.zeros(15)
    assert R.chosen_frames("pose", 16, {"energy": None, "box": still, "image": scores}, 8)[2] == "image"
    assert R.chosen_frames("pose", 16, {"energy": None, "box": scores, "image": still}, 8)[2] == "box"
    assert R.chosen_frames("pose", 16, {"energy": still, "box": scores, "image": scores}, 8)[:3] == (R.evenly(16, 8), "even_spacing", "nothing_moves")
    assert R.chosen_frames("macro", 16, {"trajectory": None}, 8)[1:3] == ("even_spacing", "no_trajectory")
    assert R.chosen_frames("edge", 16, {}, 8)[:3] == (R.evenly(16, 8), "even_spacing", "unknown_gate")
    rng = np.random.default_rng(1)
    for n in range(9, 30):
        for most in (2, 3, 8):
            got = R.around_peaks(rng.random(n - 1) - 0.3, n, most)
            assert len(got) == most and got[0] == 0 and got[-1] == n - 1 and got == sorted(set(got))


def test_pose_quality(spark):
    from watchplan.operators import filters

    rows = [(0.84, 0.1, 0.1, 9, 9), (0.85, 0.69, 0.1, 9, 9), (0.85, 0.7, 0.79, 9, 9), (0.85, 0.7, 0.8, 3, 9), (0.85, 0.7, 0.8, 2, 3), (0.85, 0.7, 0.8, 2, 2), (None, 1.0, 1.0, 0, 0), (1.0, 1.0, 1.0, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, a double, b double, c double, d int, e int").orderBy("n")
    got = [r["x"] for r in df.select("n", filters.pose_quality(*(F.col(c) for c in "abcde")).alias("x")).orderBy("n").collect()]
    assert got == ["few_valid_frames", "low_confidence", "few_valid_keypoints", "ambiguous_poses", "low_overlap", None, "few_valid_frames", None]
