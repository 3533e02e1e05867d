"""Mixtures are fitted until rounds add nothing, and rows that repeat are weights."""

import numpy as np

from watchplan import catalog
from watchplan.operators import calibration as C
from watchplan.plans import views as V


def _one_more_round(x, m):
    """Mean log-likelihood before and after a round of plain expectation maximisation."""
    each = m.log_parts(x)
    r = np.exp(each - m.log_density(x))
    n = r.sum(1)
    means = r @ x / n[:, None]
    cov = np.stack([(w[:, None] * (x - mu)).T @ (x - mu) / k + 1e-6 * np.eye(x.shape[1]) for w, mu, k in zip(r, means, n, strict=True)])
    return m.log_density(x).mean(), C.Mixture(n / n.sum(), means, cov).log_density(x).mean()


def _close(n=400):
    rng = np.random.default_rng(5)
    return np.r_[rng.normal(0, 1, (n, 2)), rng.normal(1.5, 1.2, (n, 2))] + 1e5  # components overlap, so rounds add little each, far from zero


def test_a_fit_ends_where_rounds_add_nothing(spark):
    x = _close()
    m, ll = C.fit_mixture(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"], 2)
    before, after = _one_more_round(x - 1e5, C.Mixture(m.weights, m.means - 1e5, m.covariances))
    assert after - before < 2e-6 and abs(ll - before) < 2e-6


def test_rows_that_repeat_change_nothing(spark):
    x = _close(100)
    once, many = (spark.createDataFrame(v.tolist(), "a double, b double").repartition(3) for v in (x, np.repeat(x, 20, 0)))
    (one, ll), (other, ll2) = (C.fit_mixture(df, ["a", "b"], 3, rounds=12) for df in (once, many))
    assert np.allclose(one.means, other.means) and abs(ll - ll2) < 1e-9
    assert len(np.unique(np.round(other.means, 6), axis=0)) == 3  # components that start alike stay alike


def test_rows_without_a_finite_feature_and_few_rows(spark):
    rows = [(1.0, 2.0), (1.0, 2.0), (3.0, 1.0), (None, 1.0), (2.0, float("inf")), (float("nan"), 0.0)]
    m, ll = C.fit_mixture(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 3)
    assert np.isfinite(ll) and np.allclose(m.weights @ m.means, [5 / 3, 5 / 3])


def test_queries_fit_until_nothing_is_added(spark, small):
    rows = V.logs(spark, small).where("quality is not null").selectExpr("id", "value / 100 AS x", "k / 50 AS y")
    x = rows.select("x", "y").toPandas().to_numpy(float)
    got = {r["k"]: r["bic"] for r in catalog.QUERIES["m05_information_criteria"](spark, small).collect()}
    for k in (2, 3):
        m, ll = C.fit_mixture(rows, ["x", "y"], k)
        before, after = _one_more_round(x, m)
        assert after - before < 2e-6 and abs(got[k] - C.bic(before, len(x), m.parameters())) < 2 * len(x) * 1e-5
    scores = {r["id"]: r["nll"] for r in catalog.QUERIES["m04_mixture_scores"](spark, small).collect()}
    assert abs(np.mean(list(scores.values())) + before) < 1e-5
