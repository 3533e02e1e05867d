"""Features of many windows at once, against one by one."""

import numpy as np
import pytest

from watchplan.operators import motion as M


def _walks(rng, n, rows):
    t = np.cumsum(rng.choice([0.0, 0.1, 0.4, 2.0], (n, rows)), 1)
    x, y = (np.cumsum(rng.choice([0.0, 0.05, 0.3, 4.0, -0.2], (n, rows)) * rng.random((n, 1)), 1) for _ in range(2))
    x[0], y[0], t[1] = 1.0, 2.0, 5.0  # stands; no time goes by
    return t, x, y


@pytest.mark.parametrize("rows", [3, 8, 11])
def test_macro_features_at_once(rows):
    t, x, y = _walks(np.random.default_rng(rows), 300, rows)
    want = [list(M.macro_features(*row).values()) for row in zip(t, x, y, strict=True)]
    assert np.allclose(M.many_macro_features(t, x, y), want)


@pytest.mark.parametrize("frames", [2, 8])
def test_poses_at_once(frames):
    rng = np.random.default_rng(frames)
    t = _walks(rng, 200, frames)[0]
    p = rng.random((200, frames, 17, 3))
    p[..., 2] *= rng.random((200, 1, 1))  # from windows of trusted points to windows without any
    flat = p.reshape(200, -1)
    assert np.allclose(M.many_pose_features(t, flat), [[M.pose_features(a, b)[k] for k in M.POSE] for a, b in zip(t, flat, strict=True)])
    a, b = p[:, :-1] * 9, p[:, 1:] * 9
    sure = np.minimum(p[:, :-1, :, 2], p[:, 1:, :, 2]) >= 0.3
    want = [[M.pose_energy(u[..., :2], v[..., :2], w) for u, v, w in zip(*row, strict=True)] for row in zip(a, b, sure, strict=True)]
    assert np.allclose(M.many_pose_energies(a[..., :2], b[..., :2], sure), want)


def test_odd_windows_go_one_by_one_beside_the_others(spark):
    rows = [(1, [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0, 3.0], [0.0] * 4), (2, [0.0, 1.0, 2.0, 3.0], [0.0, None, 2.0, 3.0], [0.0] * 4), (3, [0.0], [1.0], [1.0]), (4, [], [], [])]
    got = {r["k"]: r for r in M.window_features(spark.createDataFrame(rows[:3], "k long, t array<double>, x array<double>, y array<double>"), {"k": "long"}, False).collect()}
    assert set(got) == {1, 2, 3} and got[1]["mean_speed"] == 1.0 and got[3]["stationary"] == 1.0
