"""Operators with no SQL twin, against plain numpy or by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchplan.functions import geometry as G
from watchplan.functions import text as T
from watchplan.functions import time as D
from watchplan.operators import calibration as C
from watchplan.operators import matching as M
from watchplan.operators import motion, mutations, ranking
from watchplan.operators.aggregates import percent


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_modes(spark):
    assert [one(spark, percent(F.lit(k), F.lit(8))) for k in (1, 3)] == [12, 38]
    assert one(spark, percent(F.lit(1), F.lit(0))) == 0


@pytest.mark.parametrize(("said", "ms"), [("PT1.5S", 1500.0), ("PT2M3S", 123000.0), ("01:02:03.5", 3723500.0), ("42", 42.0), ("soon", None)])
def test_durations(spark, said, ms):
    assert one(spark, D.duration_ms(F.lit(said))) == ms


@pytest.mark.parametrize(("said", "json"), [("```json\n{\"a\": 1,}\n```", '{"a": 1}'), ("x {\"a\": [1,2,]} y", '{"a": [1,2]}'), ("{broken", None), ("", None), (None, None)])
def test_lenient_json(spark, said, json):
    assert one(spark, T.lenient_json(F.lit(said).cast("string"))) == json


def test_geometry(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert one(spark, G.in_polygon(F.lit(1.0), F.lit(1.5), square)) and not one(spark, G.in_polygon(F.lit(3.0), F.lit(1.0), square))
    image, world = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (8, 0), (8, 6), (0, 6)]
    h, residual = G.homography(image, world)
    assert residual["max"] < 1e-9
    u, v = G.projected(h, F.lit(5.0), F.lit(5.0))
    assert abs(one(spark, u) - 4) < 1e-9 and abs(one(spark, v) - 3) < 1e-9
    assert one(spark, G.projected([[1, 0, 0], [0, 1, 0], [0, 0, 0]], F.lit(1.0), F.lit(1.0))[0]) is None
    with pytest.raises(ValueError):
        G.homography(image[:3], world[:3])


def mixture_rows(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (150, 2)), rng.normal(8, 0.5, (150, 2))]
    return x, spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")


def test_mixture(spark):
    x, df = mixture_rows(spark)
    one_, ll1 = C.fit_mixture(df, ["a", "b"], 1)
    assert np.allclose(one_.means[0], x.mean(0)) and np.allclose(one_.covariances[0], np.cov(x.T, ddof=0) + 1e-6 * np.eye(2))
    two, ll2 = C.fit_mixture(df, ["a", "b"], 2, rounds=40)
    assert ll2 > ll1 + 0.5 and sorted(np.round(two.means[:, 0])) == [0, 8]
    assert C.bic(ll2, 300, two.parameters()) < C.bic(ll1, 300, one_.parameters())
    m, c = one_.means[0], one_.covariances[0]
    want = 0.5 * (np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) + np.log(np.linalg.det(c)) + 2 * math.log(2 * math.pi))
    got = [r["nll"] for r in C.negative_log_likelihood(df, ["a", "b"], one_).orderBy("id").collect()]
    assert np.allclose(got, want)


def test_principal_components(spark):
    x, df = mixture_rows(spark)
    means, comp, var = C.principal_components(df, ["a", "b"], 2)
    assert np.allclose(sorted(var), np.linalg.eigvalsh(np.cov(x.T, ddof=0)))
    p = C.projected(df, ["a", "b"], means, comp).select("pc1", "pc2").toPandas().to_numpy()
    assert abs(np.cov(p.T)[0, 1]) < 1e-8


def test_nearest_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 6))
    v[7] = v[3]
    df = spark.createDataFrame([(k, r.tolist(), k % 4) for k, r in enumerate(v)], "vec_id long, v array<double>, label long").repartition(3)
    monkeypatch.setattr(M, "BLOCK", 10)  # 120 queries: two chunks of blocks
    got = {(r["query_id"], r["rank"]): r["other_id"] for r in M.nearest(df, df, 4).collect()}
    n = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(n @ n.T, 12)
    for q in range(120):
        order = [k for k in np.lexsort((np.arange(120), -s[q])) if k != q][:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == order
    few = M.nearest(df.where("vec_id < 5"), df, 3, "euclidean").collect()
    dist = np.linalg.norm(v[:, None] - v[None], axis=2)
    assert all(abs(r["value"] - dist[r["query_id"], r["other_id"]]) < 1e-6 for r in few) and len(few) == 15


def test_identity_margin_single_and_empty(spark):
    top = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.7)], "query_id long, other_id long, value double")
    labels = spark.createDataFrame([(10, 5), (11, 6)], "other_id long, label long")
    r = {x["query_id"]: x for x in M.decision(M.identities(top, labels), 0.62, 0.03).collect()}
    assert r[1]["second"] == 6 and abs(r[1]["margin"] - 0.1) < 1e-12 and r[2]["margin"] is None and r[2]["decision"] == "match"
    assert M.identities(top.limit(0), labels).count() == 0


def test_peaks_and_even_sample(spark):
    assert one(spark, ranking.peaks(F.array(*map(F.lit, [0.0, 5.0, 4.0, 0.0, 3.0, 3.0])), 3)) == [1, 5]
    keys = F.array(*map(F.lit, range(16)))
    picked = one(spark, ranking.even_sample(keys, 8))
    assert len(picked) == 8 and picked[0] == 0 and picked[-1] == 15
    assert one(spark, ranking.even_sample(keys, 1)) == [0]


def test_motion_features(spark):
    f = motion.macro_features(np.arange(5.0), np.arange(5.0), np.zeros(5))
    assert f["mean_speed"] == 1 and f["straightness"] == 1 and f["direction_change"] == 0 and f["stationary"] == 0
    still = motion.macro_features(np.arange(3.0), np.array([0.0, 100, 0]), np.zeros(3))  # impossible speeds
    assert still["mean_speed"] == 0 and still["stationary"] == 1
    assert np.allclose(motion.savgol(np.arange(9.0) ** 2), np.arange(9.0) ** 2)
    assert motion.median_filtered(np.array([1.0, 9, 1, 1, 1]))[1] == 1


def test_upsert_keeps_last_value_that_is_there(spark):
    old = spark.createDataFrame([(1, 1, 0.5, "a")], "k long, at long, conf double, label string")
    new = spark.createDataFrame([(1, 2, 0.3, None), (2, 1, None, None)], "k long, at long, conf double, label string")
    r = {x["k"]: (x["conf"], x["label"]) for x in mutations.upserted(old, new, ["k"], ["at"], ["conf"], ["label"]).collect()}
    assert r == {1: (0.5, "a"), 2: (None, None)}
