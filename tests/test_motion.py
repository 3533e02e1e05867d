"""Motion and pose features against plain loops, and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchplan import catalog
from watchplan.catalog.calibration import _poses
from watchplan.functions import geometry as G
from watchplan.operators import motion as M


def plain_macro(t, x, y):
    steps = [(x[k] - x[k - 1], y[k] - y[k - 1], t[k] - t[k - 1]) for k in range(1, len(t)) if t[k] - t[k - 1] > 1e-6]
    used = [(a, b, d) for a, b, d in steps if math.hypot(a, b) / d <= 3.0]
    speeds = [math.hypot(a, b) / d for a, b, d in used] or [0.0]
    accelerations = []
    for (a, b, d), (e, f, g) in zip(used, used[1:], strict=False):
        size = math.hypot(e / g - a / d, f / g - b / d) / (0.5 * (d + g))
        if size <= 6.0:
            accelerations.append(size)
    path = sum(math.hypot(a, b) for a, b, _ in used)
    away = math.hypot(sum(a for a, _, _ in used), sum(b for _, b, _ in used))
    angles = [math.atan2(b, a) for a, b, _ in steps]
    turns = [abs((q - p + math.pi) % (2 * math.pi) - math.pi) for p, q in zip(angles, angles[1:], strict=False)]
    return [np.mean(speeds), np.median(speeds), np.percentile(speeds, 95), np.percentile(accelerations, 95) if accelerations else 0.0, min(1.0, away / path) if path > 1e-9 else 0.0, np.mean(turns) if turns else 0.0, np.mean([s < 0.05 for s in speeds])]


def test_macro_features():
    rng = np.random.default_rng(4)
    for n in (2, 3, 8, 30):
        for scale in (0.01, 1.0, 5.0):
            t = np.cumsum(rng.uniform(0, 1.5, n).round())
            x, y = (np.cumsum(rng.normal(0, scale, n)) for _ in range(2))
            if (np.diff(t) > 1e-6).any():
                assert np.allclose(list(M.macro_features(t, x, y).values()), plain_macro(t, x, y))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_smoothing(n):
    x = np.random.default_rng(n).normal(size=n)
    size = 1 if n < 3 else min(5, n if n % 2 else n - 1)
    medians = [np.median(x[max(0, k - size // 2) : k + size // 2 + 1]) for k in range(n)]
    assert np.allclose(M.median_filtered(x), medians)
    out = []
    for k in range(n):
        at = min(max(0, k - size // 2), n - size)
        out.append(np.polyval(np.polyfit(np.arange(at, at + size) - k, x[at : at + size], min(2, size - 1)), 0) if size > 1 else x[k])
    assert np.allclose(M.savgol(x), out)


def plain_series(t, p, valid):
    """The nine series, value by value."""
    limbs, left, right = [7, 8, 9, 10, 13, 14, 15, 16], [7, 9, 13, 15], [8, 10, 14, 16]
    pairs = [(k - 1, k) for k in range(1, len(t)) if t[k] - t[k - 1] > 1e-6]
    speed = lambda a, b, i: np.linalg.norm(p[b, i] - p[a, i]) / (t[b] - t[a]) if valid[a, i] and valid[b, i] else None
    speeds = lambda ids: [s for a, b in pairs for i in ids if (s := speed(a, b, i)) is not None]
    accelerations = []
    for i in limbs:
        own = [(b, s) for a, b in pairs if (s := speed(a, b, i)) is not None]
        accelerations += [abs(s - r) / (t[b] - t[a]) for (a, r), (b, s) in zip(own, own[1:], strict=False) if t[b] - t[a] > 1e-6]

    def middle(k, ids):
        own = [p[k, i] for i in ids if valid[k, i]]
        return np.mean(own, axis=0) if own else None

    def changes(value):
        vs = [value(k) for k in range(len(t))]
        return [(vs[a], vs[b], t[b] - t[a]) for a, b in pairs if vs[a] is not None and vs[b] is not None]

    def both(k, f):
        s, h = middle(k, [5, 6]), middle(k, [11, 12])
        return None if s is None or h is None else f(s, h)

    def reach(k):
        own = [np.linalg.norm(p[k, a] - p[k, b]) for a, b in ((5, 9), (6, 10)) if valid[k, a] and valid[k, b]]
        return np.mean(own) if own else None

    uneven = []
    for a, b in pairs:
        sides = [[s for i in ids if (s := speed(a, b, i)) is not None] for ids in (left, right)]
        if all(sides):
            uneven.append(abs(np.mean(sides[0]) - np.mean(sides[1])))
    wrap = lambda d: abs((d + math.pi) % (2 * math.pi) - math.pi)
    return {
        "wrist_speed": speeds([9, 10]), "ankle_speed": speeds([15, 16]), "limb_speed": speeds(limbs), "limb_acceleration": accelerations,
        "torso_speed": [np.linalg.norm(v - u) / d for u, v, d in changes(lambda k: both(k, lambda s, h: (s + h) / 2))],
        "body_angle": [wrap(v - u) / d for u, v, d in changes(lambda k: both(k, lambda s, h: math.atan2(s[1] - h[1], s[0] - h[0])))],
        "crouch": [abs(v - u) / d for u, v, d in changes(lambda k: both(k, lambda s, h: abs(h[1] - s[1])))],
        "arm_extension": [abs(v - u) / d for u, v, d in changes(reach)], "asymmetry": uneven,
    }


def test_pose_features(spark, small):
    rng = np.random.default_rng(5)
    for trial in range(30):
        n = int(rng.integers(1, 9))
        frames = rng.uniform(0, 1, (n, 17, 3))
        t = np.cumsum(rng.integers(0, 3, n)).astype(float)
        valid = frames[..., 2] >= 0.3 * (trial % 3)
        got = M.pose_features(t, frames.ravel(), 0.3 * (trial % 3))
        want = {"valid_frames": np.mean(valid.sum(1) >= 5), "confidence": frames[..., 2][valid].mean() if valid.any() else 0.0, "valid_points": valid.mean()}
        for name, v in plain_series(t, frames[..., :2], valid).items():
            want |= {f"{name}_mean": np.mean(v) if v else 0.0, f"{name}_p95": np.percentile(v, 95) if v else 0.0, f"{name}_max": max(v, default=0.0)}
        assert list(got) == M.POSE == list(want) and len(got) == 30 and np.allclose(list(got.values()), list(want.values())), trial
    windows = {(r["user_id"], r["event_type"], r["start_index"]): r for r in _poses(spark, small).collect()}
    rows = catalog.QUERIES["m11_pose_features"](spark, small).collect()
    assert len(rows) == len(windows) > 0
    for r in rows:
        w = windows[r["user_id"], r["event_type"], r["start_index"]]
        assert np.allclose([r[c] for c in M.POSE], list(M.pose_features(w["t"], w["flat"]).values()))


def test_pose_energy():
    body = np.random.default_rng(6).uniform(0, 100, (17, 2))
    every = np.ones(17, bool)
    assert M.pose_energy(body, body, every) == 0 == M.pose_energy(body, body + 5, ~every)
    size = np.percentile(np.linalg.norm(body - np.median(body, axis=0), axis=1), 75)
    assert np.isclose(M.pose_energy(body, body + [3.0, 4.0], every), 5 / size + 0.5 * (5 / size + 0.5 * 5 / size + 0.5 * 5 / size))  # moved as a whole: no turn
    turned = body @ np.array([[0.0, 1.0], [-1.0, 0.0]])  # a quarter turn about the origin
    moves = np.linalg.norm(turned - body, axis=1) / size
    torso = np.linalg.norm(turned[[5, 6, 11, 12]].mean(0) - body[[5, 6, 11, 12]].mean(0)) / size
    assert np.isclose(M.pose_energy(body, turned, every), moves.mean() + 0.5 * (torso + math.pi / 2 + 0.5 * moves[[9, 10]].mean() + 0.5 * moves[[15, 16]].mean()))


def test_homography_with_outliers():
    h = [[0.8, 0.05, 1.0], [-0.1, 0.6, 2.0], [0.001, 0.002, 1.0]]
    image = [(float(k % 6), float(k // 6)) for k in range(30)]
    world = []
    for k, (x, y) in enumerate(image):
        w = h[2][0] * x + h[2][1] * y + 1
        world.append(((h[0][0] * x + h[0][1] * y + h[0][2]) / w + (2.0 if k in (4, 17, 23) else 0.0), (h[1][0] * x + h[1][1] * y + h[1][2]) / w))
    got, off = G.homography(image, world, ransac=0.01)
    assert np.allclose(got, h) and off["inliers"] == 27 and abs(off["max"] - 2) < 1e-6 and off["median"] < 1e-9
    plain, spoilt = G.homography(image, world)
    assert spoilt["inliers"] == 30 and spoilt["median"] > 0.01 and not np.allclose(plain, h)


def test_savgol_as_column(spark):
    from pyspark.sql import Window

    rng = np.random.default_rng(7)
    tracks = {n: rng.normal(size=n) for n in (1, 2, 3, 4, 5, 6, 11)}
    df = spark.createDataFrame([(n, k, float(v)) for n, x in tracks.items() for k, v in enumerate(x)], "t int, k int, v double")
    w = Window.partitionBy("t").orderBy("k")
    out = df.select("t", "k", M.savgol_column("v", w, F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy("t"))).alias("s"))
    got = {(r["t"], r["k"]): r["s"] for r in out.collect()}
    for n, x in tracks.items():
        assert np.allclose([got[n, k] for k in range(n)], M.savgol(x))


def plain_all_macro(t, x, y, smooth):
    """One window, step by step."""
    n = len(t)
    valid = [all(math.isfinite(v) for v in p) for p in zip(t, x, y)]
    if sum(valid) < 2:
        return None
    near = [min((j for j in range(n) if valid[j]), key=lambda j: (abs(i - j), j)) for i in range(n)]
    x, y = np.array([x[j] for j in near]), np.array([y[j] for j in near])
    if smooth:
        x, y = (M.savgol(M.median_filtered(z)) for z in (x, y))
    steps = [(x[i + 1] - x[i], y[i + 1] - y[i], t[i + 1] - t[i]) for i in range(n - 1) if valid[i] and valid[i + 1] and t[i + 1] - t[i] > 1e-6]
    if not steps:
        return None
    used = [s for s in steps if math.hypot(s[0], s[1]) / s[2] <= 3.0] or [(0.0, 0.0, 0.4)]
    v = [math.hypot(a, b) / d for a, b, d in used]
    vx, vy, dt = [a / d for a, _, d in used], [b / d for _, b, d in used], [d for *_, d in used]
    path, away = sum(math.hypot(a, b) for a, b, _ in used), math.hypot(sum(a for a, *_ in used), sum(b for _, b, _ in used))
    acc = [math.hypot(vx[k] - vx[k - 1], vy[k] - vy[k - 1]) / ((dt[k] + dt[k - 1]) / 2) for k in range(1, len(used))]
    acc = [a for a in acc if a <= 6.0] or [0.0]
    turn = [abs(math.atan2(math.sin(d), math.cos(d))) for d in (math.atan2(vy[k], vx[k]) - math.atan2(vy[k - 1], vx[k - 1]) for k in range(1, len(used)))] or [0.0]
    own = [k for k in range(n) if valid[k]]
    return [
        max(t[k] for k in own) - min(t[k] for k in own), away, path, min(1.0, away / path) if path > 1e-9 else 0.0, np.mean(v), np.median(v), np.std(v), max(v), np.percentile(v, 95), np.mean(vx), np.mean(vy), np.std(vx), np.std(vy),
        np.mean(acc), np.median(acc), max(acc), np.percentile(acc, 95), np.mean(turn), max(turn), np.mean([s <= 0.05 for s in v]), len(own) / n, len(used) / (n - 1), np.mean(dt), max(dt), min(x[own]), max(x[own]), min(y[own]), max(y[own]),
    ]


@pytest.mark.parametrize("smooth", [True, False])
def test_all_macro_features(spark, smooth):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        n = int(rng.choice([2, 3, 5, 8, 16]))
        t = np.cumsum(rng.choice([0.0, 0.2, 0.4, 0.4, 1.0], n))
        x, y = np.cumsum(rng.normal(0, 0.5, n)), np.cumsum(rng.normal(0, 0.5, n))
        x[rng.random(n) < 0.15] = np.nan
        y[rng.random(n) < 0.05] = np.inf
        if k % 10 == 0:
            x = x * 100  # impossible speeds
        rows.append((k, t.tolist(), x.tolist(), y.tolist()))
    rows += [(900, [0.0, 1.0], [None, 1.0], [1.0, 2.0]), (901, [1.0, 1.0, 1.0], [0.0, 1.0, 2.0], [0.0] * 3), (902, [1.0], [1.0], [1.0]), (903, [], [], [])]
    df = spark.createDataFrame(rows, "k long, t array<double>, x array<double>, y array<double>").repartition(3)
    got = {r["k"]: list(r)[1:] for r in M.all_window_features(df, {"k": "long"}, smooth).collect()}
    assert len(got) == len(rows)
    for k, t, x, y in rows:
        want = plain_all_macro(t, [math.nan if v is None else v for v in x], y, smooth)
        if want is None:
            assert got[k] == [None] * 28, k
        else:
            assert got[k] == pytest.approx(want, abs=1e-9), k
