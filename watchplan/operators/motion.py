"""Motion and pose features of a track's window: smoothing, seven macro features, thirty pose features, transition scores.

A window is bounded (its length is a parameter), so its features are made of small arrays in Arrow batches, a row in
and a row out; what needs a neighbouring row alone is a window expression over the track.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: Speeds and accelerations beyond these are measuring errors; below the last a person stands.
MOST_SPEED, MOST_ACCELERATION, STANDSTILL = 3.0, 6.0, 0.05
MACRO = ["mean_speed", "median_speed", "p95_speed", "p95_acceleration", "straightness", "direction_change", "stationary"]
#: Places of the 17 keypoints.
SHOULDERS, WRISTS, HIPS, ANKLES = (5, 6), (9, 10), (11, 12), (15, 16)
LEFT, RIGHT = (7, 9, 13, 15), (8, 10, 14, 16)
SERIES = ["wrist_speed", "ankle_speed", "limb_speed", "limb_acceleration", "torso_speed", "body_angle", "crouch", "arm_extension", "asymmetry"]
POSE = ["valid_frames", "confidence", "valid_points", *(f"{s}_{k}" for s in SERIES for k in ("mean", "p95", "max"))]


def _odd(size: int, n: int) -> int:
    """A window of an odd number of points, no wider than n points allow; 1 if there are too few to smooth."""
    if size <= 1 or n < 3:
        return 1
    return min(size + 1 - size % 2, n if n % 2 else n - 1)


def median_filtered(x: np.ndarray, size: int = 5) -> np.ndarray:
    """The median around each point, of fewer points at the ends."""
    half = _odd(size, len(x)) // 2
    return np.array([np.median(x[max(0, k - half) : k + half + 1]) for k in range(len(x))])


def savgol(x: np.ndarray, size: int = 5, order: int = 2) -> np.ndarray:
    """A polynomial fitted around each point; at the ends the window is shifted, not shortened."""
    size = _odd(size, len(x))
    if size < 3:
        return np.array(x, float)
    weights = savgol_weights(size, order)
    at = np.clip(np.arange(len(x)) - size // 2, 0, len(x) - size)
    return np.array([weights[k - a] @ x[a : a + size] for k, a in enumerate(at)])


def savgol_weights(size: int, order: int) -> np.ndarray:
    """Row j: how much each point of the window counts for the fitted value at its j-th point."""
    powers = np.vander(np.arange(size) - size // 2, max(1, min(order, size - 1)) + 1).astype(float)
    return powers @ np.linalg.pinv(powers)


def savgol_column(value: str, w: WindowSpec, place: Column, rows: Column, size: int = 5, order: int = 2) -> Column:
    """savgol() of an ordered track as lags and leads; place: the row's number from 0, rows: how many the track has.

    Tracks of fewer than `size` rows (5: windows of 3, which a parabola fits exactly) stay as they are.
    """
    weights, half = savgol_weights(size, order), size // 2
    own = F.when(place < half, place).when(rows - 1 - place < half, size - (rows - place)).otherwise(half)
    near = lambda k: F.col(value) if not k else F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    out = F.col(value)
    for j in range(size):
        out = F.when((rows >= size) & (own == j), sum((near(m - j) * float(weights[j, m]) for m in range(size)), F.lit(0.0))).otherwise(out)
    return out


def macro_features(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Seven features of a path on the floor.

    Steps of impossible speed are left out of everything but turns; accelerations are those of velocity vectors
    between the steps that are left, impossible ones left out too.  Without any speed a person stands.
    """
    dt = np.diff(t)
    step = np.stack([np.diff(x), np.diff(y)], 1)[dt > 1e-6]
    dt = dt[dt > 1e-6]
    speed = np.hypot(*step.T) / dt
    good = np.isfinite(speed) & (speed <= MOST_SPEED)
    used, own = step[good], dt[good]
    v = speed[good] if good.any() else np.zeros(1)
    a = np.hypot(*(np.diff(used / own[:, None], axis=0) / (0.5 * (own[1:] + own[:-1]))[:, None]).T) if len(used) > 1 else np.zeros(0)
    a = a[np.isfinite(a) & (a <= MOST_ACCELERATION)]
    path = float(np.hypot(*used.T).sum())
    away = float(np.hypot(*used.sum(0)))
    turn = np.diff(np.arctan2(step[:, 1], step[:, 0]))
    turn = np.abs((turn + np.pi) % (2 * np.pi) - np.pi)
    return {
        "mean_speed": float(v.mean()), "median_speed": float(np.median(v)), "p95_speed": float(np.percentile(v, 95)), "p95_acceleration": float(np.percentile(a, 95)) if len(a) else 0.0,
        "straightness": min(1.0, away / path) if path > 1e-9 else 0.0, "direction_change": float(turn.mean()) if len(turn) else 0.0, "stationary": float((v < STANDSTILL).mean()),
    }


def _summed_up(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, median, 95th percentile, maximum) of each row without its NaNs; 0 for a row without any other."""
    s = np.sort(v, axis=1)  # NaNs come last
    n = np.isfinite(s).sum(1)
    safe, some = np.maximum(n, 1), n > 0

    def at(share: float) -> np.ndarray:
        place = share * (safe - 1)
        low = np.floor(place).astype(int)
        a, b = (np.take_along_axis(s, k[:, None], 1)[:, 0] for k in (low, np.minimum(low + 1, safe - 1)))
        return np.where(some, a + (b - a) * (place - low), 0.0)

    return np.where(some, np.nansum(v, 1) / safe, 0.0), at(0.5), at(0.95), at(1.0)


def _before(used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place of a row: the place of the last used one before it (0 without any), and whether both are used."""
    last = np.maximum.accumulate(np.where(used, np.arange(used.shape[1]), -1), 1)
    last = np.concatenate([np.full((len(last), 1), -1), last[:, :-1]], 1)
    return np.maximum(last, 0), used & (last >= 0)


def many_macro_features(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """macro_features of many windows of one length (rows), whose numbers are all finite: MACRO by column."""
    only = lambda v, m: np.where(m, v, np.nan)
    dt, dx, dy = np.diff(t), np.diff(x), np.diff(y)
    kept = dt > 1e-6
    own = np.where(kept, dt, 1.0)
    speed = np.hypot(dx, dy) / own
    used = kept & np.isfinite(speed) & (speed <= MOST_SPEED)
    v = only(speed, used)
    v[~used.any(1), :1] = 0.0
    at, pair = _before(used)
    of = lambda z: np.take_along_axis(z, at, 1)
    vx, vy = dx / own, dy / own
    a = np.hypot(vx - of(vx), vy - of(vy)) / (0.5 * (own + of(own)))
    a = only(a, pair & np.isfinite(a) & (a <= MOST_ACCELERATION))
    path = np.where(used, np.hypot(dx, dy), 0.0).sum(1)
    away = np.hypot(np.where(used, dx, 0.0).sum(1), np.where(used, dy, 0.0).sum(1))
    at, pair = _before(kept)
    way = np.arctan2(dy, dx)
    turn = only(np.abs((way - np.take_along_axis(way, at, 1) + np.pi) % (2 * np.pi) - np.pi), pair)
    mean, median, p95, _most = _summed_up(v)
    straight = np.minimum(1.0, np.divide(away, path, out=np.zeros_like(path), where=path > 1e-9))
    return np.stack([mean, median, p95, _summed_up(a)[2], straight, _summed_up(turn)[0], (v < STANDSTILL).sum(1) / np.isfinite(v).sum(1)], 1)


#: The offline extractor's features of a window, seven of which are those above.
MACRO_ALL = [
    "duration", "displacement", "path_length", "straightness", "speed_mean", "speed_median", "speed_std", "speed_max", "speed_p95", "vx_mean", "vy_mean", "vx_std", "vy_std",
    "acceleration_mean", "acceleration_median", "acceleration_max", "acceleration_p95", "turn_mean", "turn_max", "stationary", "valid_points", "valid_steps", "dt_mean", "dt_max", "x_min", "x_max", "y_min", "y_max",
]


def _filled(valid: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values, of many windows (rows), with that of the nearest valid place, the earlier of two, where a place isn't valid."""
    n = valid.shape[1]
    at = np.broadcast_to(np.arange(n), valid.shape)
    before = np.maximum.accumulate(np.where(valid, at, -1), 1)
    after = np.minimum.accumulate(np.where(valid, at, 2 * n)[:, ::-1], 1)[:, ::-1]
    from_before = (before >= 0) & (at - before <= after - at)
    source = np.clip(np.where(from_before, before, after), 0, n - 1)
    return [np.take_along_axis(v, source, 1) for v in values]


def smoothed_windows(v: np.ndarray, size: int = 5, order: int = 2) -> np.ndarray:
    """median_filtered, then savgol, of many windows (rows) at once: savgol is one matrix for windows of one length."""
    n = v.shape[1]
    half = _odd(size, n) // 2
    wide = np.pad(v, ((0, 0), (half, half)), constant_values=np.nan)
    v = np.nanmedian(np.stack([wide[:, k : k + n] for k in range(2 * half + 1)]), 0)
    return v @ np.stack([savgol(row, size, order) for row in np.eye(n)])


def macro_windows(t: np.ndarray, x: np.ndarray, y: np.ndarray, smooth: bool = True) -> np.ndarray:
    """MACRO_ALL of many windows of one length (rows): all at once; NaN where a window has fewer than two valid points or no step in time.

    A point is valid if its place and time are finite; others stand in for smoothing alone.  Steps of impossible speed are left out of
    all that follows from steps; accelerations and turns are between the steps that are left, impossible accelerations are left out too.
    Without any step left the window is one standing step of 0.4 seconds.
    """
    valid = np.isfinite(t) & np.isfinite(x) & np.isfinite(y)
    enough = valid.sum(1) >= 2
    x, y = _filled(valid, np.nan_to_num(x), np.nan_to_num(y))
    if smooth:
        x, y = smoothed_windows(x), smoothed_windows(y)
    dt = np.diff(np.where(valid, t, np.nan), axis=1)
    ok = valid[:, 1:] & valid[:, :-1] & (dt > 1e-6)
    enough &= ok.any(1)
    safe = np.where(ok, dt, 1.0)
    vx, vy = np.diff(x, axis=1) / safe, np.diff(y, axis=1) / safe
    speed = np.hypot(vx, vy)
    used = ok & (speed <= MOST_SPEED)
    none = ~used.any(1)
    used[none, 0], vx[none, 0], vy[none, 0], speed[none, 0], safe[none, 0] = True, 0.0, 0.0, 0.0, 0.4
    only = lambda v, m: np.where(m, v, np.nan)
    v, ax, ay, own = only(speed, used), only(vx, used), only(vy, used), only(safe, used)
    path, away = np.nansum(v * own, 1), np.hypot(np.nansum(ax * own, 1), np.nansum(ay * own, 1))
    # each used step, and the used one before it
    last = np.maximum.accumulate(np.where(used, np.arange(used.shape[1]), -1), 1)
    last = np.concatenate([np.full((len(last), 1), -1), last[:, :-1]], 1)
    pair, at = used & (last >= 0), np.maximum(last, 0)
    of = lambda z: np.take_along_axis(z, at, 1)
    a = np.hypot(vx - of(vx), vy - of(vy)) / np.maximum((safe + of(safe)) / 2, 1e-6)
    a = only(a, pair & (a <= MOST_ACCELERATION))
    a[np.isnan(a).all(1), 0] = 0.0
    turn = np.arctan2(vy, vx) - of(np.arctan2(vy, vx))
    turn = only(np.abs((turn + np.pi) % (2 * np.pi) - np.pi), pair)
    turn[np.isnan(turn).all(1), 0] = 0.0
    place, when = (only(z, valid) for z in (x, y)), only(t, valid)
    px, py = place
    px, py, when = (np.where(valid.any(1)[:, None], z, 0.0) for z in (px, py, when))
    out = np.stack([
        np.nanmax(when, 1) - np.nanmin(when, 1), away, path, np.clip(np.divide(away, path, out=np.zeros_like(path), where=path > 1e-9), 0, 1), np.nanmean(v, 1), np.nanmedian(v, 1), np.nanstd(v, 1), np.nanmax(v, 1), np.nanpercentile(v, 95, axis=1),
        np.nanmean(ax, 1), np.nanmean(ay, 1), np.nanstd(ax, 1), np.nanstd(ay, 1), np.nanmean(a, 1), np.nanmedian(a, 1), np.nanmax(a, 1), np.nanpercentile(a, 95, axis=1), np.nanmean(turn, 1), np.nanmax(turn, 1),
        np.nanmean(only(speed <= STANDSTILL, used), 1), valid.mean(1), used.sum(1) / max(1, used.shape[1]), np.nanmean(own, 1), np.nanmax(own, 1), np.nanmin(px, 1), np.nanmax(px, 1), np.nanmin(py, 1), np.nanmax(py, 1),
    ], 1)
    out[~enough] = np.nan
    return out


def all_window_features(windows: DataFrame, keys: dict[str, str], smooth: bool = True) -> DataFrame:
    """MACRO_ALL of windows with arrays t, x, y; null where there are too few valid points or steps.  Windows of one length are one array."""
    schema = ", ".join([*(f"{k} {v}" for k, v in keys.items()), *(f"{n} double" for n in MACRO_ALL)])

    def run(batches):
        for pdf in batches:
            size = pdf["t"].map(len)
            for n, own in pdf.groupby(size):
                grid = lambda c, own=own: np.array([[np.nan if v is None else v for v in row] for row in own[c]], float)
                got = macro_windows(grid("t"), grid("x"), grid("y"), smooth) if n > 1 else np.full((len(own), len(MACRO_ALL)), np.nan)
                frame = pd.DataFrame(got, columns=MACRO_ALL).astype("Float64")
                yield pd.concat([own[list(keys)].reset_index(drop=True), frame.mask(np.isnan(got))], axis=1)

    return windows.select(*keys, "t", "x", "y").mapInPandas(run, schema)


def _arrow_rows(df: DataFrame, keys: dict[str, str], columns: list[str], names: list[str], made: Callable[..., dict], many: Callable[..., np.ndarray], least: int, kind: str = "double") -> DataFrame:
    """made() of each window; windows of one length (`least` points or more) whose numbers are all finite go to many() at once, as arrays."""
    schema = ", ".join([*(f"{k} {v}" for k, v in keys.items()), *(f"{n} {kind}" for n in names)])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lengths = np.array([[-1 if v is None else len(v) for v in pdf[c]] for c in columns])
            for sizes in np.unique(lengths, axis=1).T:
                own = pdf[(lengths == sizes[:, None]).all(0)]
                whole = np.zeros(len(own), bool)
                if sizes.min() >= least:
                    grids = [np.array(own[c].to_list(), float) for c in columns]
                    whole = np.logical_and.reduce([np.isfinite(g).all(1) for g in grids])
                if whole.any():
                    got = many(*(g[whole] for g in grids))
                    frame = own.loc[whole, list(keys)].reset_index(drop=True)
                    yield pd.concat([frame, pd.DataFrame(got, columns=names) if kind == "double" else pd.DataFrame({names[0]: list(got)})], axis=1)
                if not whole.all():
                    out = [{k: row[k] for k in keys} | made(*(row[c] for c in columns)) for row in own[~whole].to_dict("records")]
                    yield pd.DataFrame(out, columns=[*keys, *names])

    return df.select(*keys, *columns).mapInPandas(run, schema)


def window_features(windows: DataFrame, keys: dict[str, str], smooth: bool = True) -> DataFrame:
    """Macro features of windows with arrays t, x, y; smooth: by medians, then by parabolas."""

    def made(t, x, y) -> dict[str, float]:
        t, x, y = (np.asarray(v, float) for v in (t, x, y))
        return macro_features(t, *((savgol(median_filtered(z)) for z in (x, y)) if smooth else (x, y)))

    def many(t, x, y) -> np.ndarray:
        return many_macro_features(t, *((smoothed_windows(z) for z in (x, y)) if smooth else (x, y)))

    return _arrow_rows(windows, keys, ["t", "x", "y"], MACRO, made, many, 3)


def pose_series(t: np.ndarray, points: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """The nine series of a window: points (frames, 17, 2) in units of the box, and which of them can be trusted.

    Changes are between a frame and the one before it, over the time between them; what is missing in either, or an
    interval of no time, gives no value.
    """
    dt = np.diff(t)
    ok = dt > 1e-6
    safe = np.where(ok, dt, 1.0)
    moved = np.where((valid[1:] & valid[:-1] & ok[:, None]), np.hypot(*np.moveaxis(np.diff(points, axis=0), -1, 0)) / safe[:, None], np.nan)
    limbs = sorted({*LEFT, *RIGHT})

    def middle(which: tuple[int, ...]) -> np.ndarray:
        seen = valid[:, which].any(1)
        total = np.where(valid[:, which, None], points[:, which], 0.0).sum(1)
        return np.where(seen[:, None], total / np.maximum(1, valid[:, which].sum(1))[:, None], np.nan)

    shoulder, hip = middle(SHOULDERS), middle(HIPS)
    change = lambda v: np.abs(np.diff(v)) / safe
    trunk = shoulder - hip
    angle = np.diff(np.arctan2(trunk[:, 1], trunk[:, 0]))
    reach = np.stack([np.where(valid[:, a] & valid[:, b], np.hypot(*(points[:, a] - points[:, b]).T), np.nan) for a, b in zip(SHOULDERS, WRISTS, strict=True)])
    count = np.isfinite(reach).sum(0)
    extension = np.where(count > 0, np.nansum(reach, 0) / np.maximum(1, count), np.nan)
    faster = []  # of each limb: changes of speed between the frames in which it has one
    for k in limbs:
        at = np.flatnonzero(np.isfinite(moved[:, k]))
        gap = np.diff(t[at + 1])
        faster.append((np.abs(np.diff(moved[at, k])) / np.where(gap > 1e-6, gap, np.nan)))
    side = lambda own: (np.nansum(moved[:, own], 1), np.isfinite(moved[:, own]).sum(1))
    (left, n_left), (right, n_right) = side(LEFT), side(RIGHT)
    uneven = np.where((n_left > 0) & (n_right > 0), np.abs(left / np.maximum(1, n_left) - right / np.maximum(1, n_right)), np.nan)
    mask = lambda v: v[ok & np.isfinite(v)]
    flat = lambda v: v[np.isfinite(v)]
    return {
        "wrist_speed": flat(moved[:, WRISTS]), "ankle_speed": flat(moved[:, ANKLES]), "limb_speed": flat(moved[:, limbs]), "limb_acceleration": flat(np.concatenate(faster)),
        "torso_speed": mask(np.hypot(*np.diff((shoulder + hip) / 2, axis=0).T) / safe), "body_angle": mask(np.abs((angle + np.pi) % (2 * np.pi) - np.pi) / safe),
        "crouch": mask(change(np.abs(trunk[:, 1]))), "arm_extension": mask(change(extension)), "asymmetry": mask(uneven),
    }


def pose_features(t, flat, least: float = 0.3) -> dict[str, float]:
    """Thirty features of a window: flat has x, y, confidence of 17 points for each frame; points below `least` aren't trusted.

    Shares of valid frames (five points at least) and points, the mean confidence of trusted points, and mean, 95th percentile and maximum of
    each series, 0 for an empty one.
    """
    frames = np.asarray(flat, float).reshape(len(t), 17, 3)
    points, confidence = frames[..., :2], frames[..., 2]
    valid = (confidence >= least) & np.isfinite(points).all(-1)
    out = {"valid_frames": float((valid.sum(1) >= 5).mean()), "confidence": float(confidence[valid].mean()) if valid.any() else 0.0, "valid_points": float(valid.mean())}
    for name, v in pose_series(np.asarray(t, float), points, valid).items():
        out |= {f"{name}_mean": float(v.mean()) if len(v) else 0.0, f"{name}_p95": float(np.percentile(v, 95)) if len(v) else 0.0, f"{name}_max": float(v.max()) if len(v) else 0.0}
    return out


def many_pose_features(t: np.ndarray, flat: np.ndarray, least: float = 0.3) -> np.ndarray:
    """pose_features of many windows of one length (rows), whose numbers are all finite: POSE by column."""
    frames = flat.reshape(*t.shape, 17, 3)
    points, confidence = frames[..., :2], frames[..., 2]
    valid = confidence >= least
    only = lambda v, m: np.where(m, v, np.nan)
    dt = np.diff(t)
    ok = dt > 1e-6
    safe = np.where(ok, dt, 1.0)
    size = lambda v: np.hypot(v[..., 0], v[..., 1])
    moved = only(size(np.diff(points, axis=1)) / safe[..., None], valid[:, 1:] & valid[:, :-1] & ok[..., None])
    limbs = sorted({*LEFT, *RIGHT})

    def middle(which: tuple[int, ...]) -> np.ndarray:
        n = valid[:, :, which].sum(2)
        total = np.where(valid[:, :, which, None], points[:, :, which], 0.0).sum(2)
        return only(total / np.maximum(1, n)[..., None], (n > 0)[..., None])

    def mean(v: np.ndarray) -> np.ndarray:
        n = np.isfinite(v).sum(-1)
        return only(np.nansum(v, -1) / np.maximum(1, n), n > 0)

    shoulder, hip = middle(SHOULDERS), middle(HIPS)
    change = lambda v: np.abs(np.diff(v, axis=1)) / safe
    trunk = shoulder - hip
    angle = np.diff(np.arctan2(trunk[..., 1], trunk[..., 0]), axis=1)
    reach = np.stack([only(size(points[:, :, a] - points[:, :, b]), valid[:, :, a] & valid[:, :, b]) for a, b in zip(SHOULDERS, WRISTS, strict=True)], -1)
    faster = []  # of each limb: changes of speed between the frames in which it has one
    for k in limbs:
        v = moved[:, :, k]
        at, pair = _before(np.isfinite(v))
        gap = t[:, 1:] - np.take_along_axis(t[:, 1:], at, 1)
        pair &= gap > 1e-6
        faster.append(only(np.abs(v - np.take_along_axis(v, at, 1)) / np.where(pair, gap, 1.0), pair))
    uneven = np.abs(mean(moved[:, :, LEFT]) - mean(moved[:, :, RIGHT]))
    series = [moved[:, :, WRISTS], moved[:, :, ANKLES], moved[:, :, limbs], np.concatenate(faster, 1), *(only(v, ok) for v in (
        size(np.diff((shoulder + hip) / 2, axis=1)) / safe, np.abs((angle + np.pi) % (2 * np.pi) - np.pi) / safe, change(np.abs(trunk[..., 1])), change(mean(reach)), uneven))]
    n = valid.sum((1, 2))
    out = [(valid.sum(2) >= 5).mean(1), np.where(valid, confidence, 0.0).sum((1, 2)) / np.maximum(1, n), valid.mean((1, 2))]
    for v in series:
        average, _median, p95, most = _summed_up(v.reshape(len(t), -1))
        out += [average, p95, most]
    return np.stack(out, 1)


def pose_windows(windows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """pose_features of windows with arrays t and flat."""
    return _arrow_rows(windows, keys, ["t", "flat"], POSE, lambda t, flat: pose_features(np.asarray(t, float), np.asarray(flat, float)), many_pose_features, 2)


def pose_energy(before: np.ndarray, now: np.ndarray, trusted: np.ndarray) -> float:
    """How much 17 points move from one frame to the next, in units of the body's size; trusted: points seen in both.

    The mean move, and half of: the torso's move, the trunk's turn, and half the wrists' and half the ankles' moves.
    """
    if not trusted.any():
        return 0.0
    size = max(1.0, float(np.percentile(np.hypot(*(before[trusted] - np.median(before[trusted], axis=0)).T), 75)))
    moved = np.hypot(*(now - before).T) / size
    middle = lambda p, which: p[list(which)].mean(0)
    trunk = lambda p: middle(p, SHOULDERS) - middle(p, HIPS)
    turn = np.arctan2(*trunk(now)[::-1]) - np.arctan2(*trunk(before)[::-1])
    torso = float(np.hypot(*(middle(now, SHOULDERS + HIPS) - middle(before, SHOULDERS + HIPS)))) / size
    more = torso + abs(np.arctan2(np.sin(turn), np.cos(turn))) + 0.5 * moved[list(WRISTS)].mean() + 0.5 * moved[list(ANKLES)].mean()
    return float(moved[trusted].mean() + 0.5 * more)


def many_pose_energies(before: np.ndarray, now: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """pose_energy of many pairs of frames, (..., 17, 2), whose numbers are all finite."""
    n = trusted.sum(-1)
    safe = np.maximum(n, 1)

    def at(v: np.ndarray, share: float) -> np.ndarray:
        s, place = np.sort(np.where(trusted, v, np.inf), -1), share * (safe - 1)
        low = np.floor(place).astype(int)
        a, b = (np.take_along_axis(s, k[..., None], -1)[..., 0] for k in (low, np.minimum(low + 1, safe - 1)))
        a, b = (np.where(n > 0, v, 0.0) for v in (a, b))
        return a + (b - a) * (place - low)

    length = lambda v: np.hypot(v[..., 0], v[..., 1])
    mid = np.stack([at(before[..., k], 0.5) for k in (0, 1)], -1)
    size = np.maximum(1.0, at(length(before - mid[..., None, :]), 0.75))
    moved = length(now - before) / size[..., None]
    middle = lambda p, which: p[..., list(which), :].mean(-2)
    trunk = lambda p: middle(p, SHOULDERS) - middle(p, HIPS)
    way = lambda v: np.arctan2(v[..., 1], v[..., 0])
    turn = way(trunk(now)) - way(trunk(before))
    torso = length(middle(now, SHOULDERS + HIPS) - middle(before, SHOULDERS + HIPS)) / size
    more = torso + np.abs(np.arctan2(np.sin(turn), np.cos(turn))) + 0.5 * moved[..., list(WRISTS)].mean(-1) + 0.5 * moved[..., list(ANKLES)].mean(-1)
    return np.where(n > 0, np.where(trusted, moved, 0.0).sum(-1) / safe + 0.5 * more, 0.0)


def pose_energies(windows: DataFrame, keys: dict[str, str], least: float = 0.3) -> DataFrame:
    """energies: pose_energy of each frame of a window but the first, of windows with an array flat as in pose_features."""

    def made(flat) -> dict:
        frames = np.asarray(flat, float).reshape(-1, 17, 3)
        pairs = zip(frames[:-1], frames[1:], strict=True)
        return {"energies": [pose_energy(a[:, :2], b[:, :2], np.minimum(a[:, 2], b[:, 2]) >= least) for a, b in pairs]}

    def many(flat) -> np.ndarray:
        frames = flat.reshape(len(flat), -1, 17, 3)
        a, b = frames[:, :-1], frames[:, 1:]
        return many_pose_energies(a[..., :2], b[..., :2], np.minimum(a[..., 2], b[..., 2]) >= least)

    return _arrow_rows(windows, keys, ["flat"], ["energies"], made, many, 102, "array<double>")


def box_transition(box: tuple[str, str, str, str], w: WindowSpec) -> Column:
    """How much a box differs from the one before it: its centre's move by the old diagonal, half the change of sizes, a quarter of that of the aspect; 0 for the first."""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    p1, q1, p2, q2 = (F.lag(c).over(w) for c in box)
    size = lambda a, b: F.greatest(F.lit(1.0), b - a)
    width, height, old_width, old_height = size(x1, x2), size(y1, y2), size(p1, p2), size(q1, q2)
    diagonal = F.greatest(F.lit(1.0), F.sqrt(old_width * old_width + old_height * old_height))
    move = F.sqrt(F.pow((x1 + x2) / 2 - (p1 + p2) / 2, 2) + F.pow((y1 + y2) / 2 - (q1 + q2) / 2, 2)) / diagonal
    change = F.abs(width - old_width) / old_width + F.abs(height - old_height) / old_height
    return F.when(p1.isNull() | x1.isNull(), 0.0).otherwise(move + 0.5 * change + 0.25 * F.abs(width / height - old_width / old_height))


def trajectory_change(x: str, y: str, w: WindowSpec) -> Column:
    """Speed, change of velocity and turn, added up, of a point against the two before it; 0 for the first, speed alone for the second."""
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    ex, ey = F.lag(x).over(w) - F.lag(x, 2).over(w), F.lag(y).over(w) - F.lag(y, 2).over(w)
    size = lambda a, b: F.sqrt(a * a + b * b)
    both = (size(dx, dy) > 1e-9) & (size(ex, ey) > 1e-9)
    turn = F.when(both, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (dx * ex + dy * ey) / (size(dx, dy) * size(ex, ey)))))).otherwise(0.0)
    return F.coalesce(size(dx, dy), F.lit(0.0)) + F.when(ex.isNull(), 0.0).otherwise(size(dx - ex, dy - ey) + turn)


def stabilised(df: DataFrame, by: list[str], w: WindowSpec, box: tuple[str, str, str, str]) -> DataFrame:
    """df with the centre and size of its boxes (cx, cy, bw, bh) and their medians over five rows of the track (s_...)."""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    out = df.withColumns({"bw": F.greatest(F.lit(1.0), x2 - x1), "bh": F.greatest(F.lit(1.0), y2 - y1)})
    out = out.withColumns({"cx": x1 + F.col("bw") / 2, "cy": y1 + F.col("bh") / 2})
    return out.withColumns({f"s_{c}": F.percentile(c, 0.5).over(w.rowsBetween(-2, 2)) for c in ("cx", "cy", "bw", "bh")})


def jitter(df: DataFrame, by: list[str], w: WindowSpec) -> DataFrame:
    """Of stabilised boxes by track: 95th percentiles of the centre's moves, raw and smoothed, and of relative changes of the area; deviation of width and height by their mean."""
    step = lambda a, b: F.sqrt(F.pow(F.col(a) - F.lag(a).over(w), 2) + F.pow(F.col(b) - F.lag(b).over(w), 2))
    area = F.col("bw") * F.col("bh")
    before = F.lag("bw").over(w) * F.lag("bh").over(w)
    rows = df.withColumns({"_raw": step("cx", "cy"), "_smooth": step("s_cx", "s_cy"), "_size": F.abs(area - before) / F.greatest(before, F.lit(1e-6))})
    p95 = lambda c: F.coalesce(F.percentile(c, 0.95), F.lit(0.0))
    spread = lambda c: F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(1e-6))
    return rows.groupBy(*by).agg(p95("_raw").alias("centre_raw"), p95("_smooth").alias("centre_smooth"), p95("_size").alias("size_change"), spread("bw").alias("width_cv"), spread("bh").alias("height_cv"))
