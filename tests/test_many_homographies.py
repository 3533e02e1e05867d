"""Homographies of many groups at once, against one by one."""

import numpy as np

from watchplan.functions import geometry as G


def test_groups_at_once_agree_with_plain_fits():
    rng, h = np.random.default_rng(5), np.array([[0.8, 0.05, 1.0], [-0.1, 0.6, 2.0], [0.001, 0.002, 1.0]])
    for n in (9, 14):
        image = rng.uniform(0, 10, (40, n, 2))
        p = np.concatenate([image, np.ones((40, n, 1))], -1) @ h.T
        world, moved = p[..., :2] / p[..., 2:], np.zeros((40, n), bool)
        for k in range(40):
            moved[k, rng.permutation(n)[: k % 4]] = True
        world[..., 0] += np.where(moved, rng.uniform(3, 9, (40, n)), 0)
        image[3, :3] = image[3, 0]  # a point thrice: fours with it lie on a line
        inside = G.agreeing(image, world, 0.05)
        assert (inside[4:] == ~moved[4:]).all()
        got, off = G.fitted(image, world, inside)
        assert np.allclose(got[4:], h, atol=1e-6) and np.allclose(off[~moved & (np.arange(40) > 3)[:, None]], 0, atol=1e-6)
    none = G.fitted(image, world, np.zeros((40, 14), bool))[0]
    assert np.isnan(none).all()


def test_draws_of_one_size_are_made_once():
    assert len(G._fours(9, 500, 0)) <= 126 and G._fours(9, 500, 0) is G._fours(9, 500, 0)
