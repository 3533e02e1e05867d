"""A mixture's weighted densities are made once for each round."""

import numpy as np

from watchplan.operators.calibration import Mixture


def test_parts_add_up_to_the_density():
    rng = np.random.default_rng(4)
    m = Mixture(np.array([0.3, 0.7]), rng.normal(size=(2, 2)), np.array([[[2.0, 0.3], [0.3, 1.0]], [[1.0, -0.2], [-0.2, 0.5]]]))
    x = rng.normal(size=(50, 2))
    own = [np.log(w) + Mixture(np.ones(1), mu[None], c[None]).log_density(x) for w, mu, c in zip(m.weights, m.means, m.covariances, strict=True)]
    assert np.allclose(m.log_parts(x), own) and np.allclose(m.log_density(x), np.log(np.exp(own).sum(0)))
