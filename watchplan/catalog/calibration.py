"""Queries of calibration and motion (M-4..M-7, M-9..M-11, M-20, J-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.functions import geometry as G
from watchplan.operators import calibration as O
from watchplan.operators import motion as M
from watchplan.operators import windows as W
from watchplan.plans import views as V
from watchplan.streaming import processors


def _two(spark, d):
    return V.logs(spark, d).where("quality is not null").select("id", (F.col("value") / 100).alias("x"), (F.col("k") / 50).alias("y"))


_TWO_SQL = "t AS (SELECT id, value / 100 AS x, k / 50 AS y FROM logs WHERE quality IS NOT NULL)"
#: One component's mean and covariance, as the fit ends with them.
_ONE_SQL = f"{_TWO_SQL}, g AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) + 1e-6 AS a, covar_pop(x, y) AS b, covar_pop(y, y) + 1e-6 AS c FROM t), s AS (SELECT t.id, g.n, 0.5 * ((g.c * (x - mx) ** 2 - 2 * g.b * (x - mx) * (y - my) + g.a * (y - my) ** 2) / (g.a * g.c - g.b * g.b) + ln(g.a * g.c - g.b * g.b) + 2 * ln(2 * pi())) AS nll FROM t, g)"


@query("m04a_gaussian_scores", f"WITH {_ONE_SQL} SELECT id, round(nll, 6) AS nll FROM s")
def _(spark, d):
    rows = _two(spark, d)
    return O.negative_log_likelihood(rows, ["x", "y"], O.fit_mixture(rows, ["x", "y"], 1)[0]).select("id", F.round("nll", 6).alias("nll"))


@query("m05a_gaussian_criteria", f"WITH {_ONE_SQL} SELECT round(5 * ln(max(n)) + 2 * sum(nll), 3) AS bic, round(10 + 2 * sum(nll), 3) AS aic FROM s")
def _(spark, d):
    rows = _two(spark, d)
    model, ll = O.fit_mixture(rows, ["x", "y"], 1)
    n = rows.count()
    return spark.createDataFrame([(round(O.bic(ll, n, model.parameters()), 3), round(O.aic(ll, n, model.parameters()), 3))], "bic double, aic double")


@query("m04_mixture_scores")
def _(spark, d):
    rows = _two(spark, d)
    model, _ll = O.fit_mixture(rows, ["x", "y"], 3)
    return O.negative_log_likelihood(rows, ["x", "y"], model).select("id", "nll")


@query("m05_information_criteria")
def _(spark, d):
    rows, ks = _two(spark, d), (1, 2, 3)
    n = rows.count()
    out = [(k, O.bic(ll, n, model.parameters()), O.aic(ll, n, model.parameters())) for k, (model, ll) in zip(ks, O.fit_mixtures(rows, ["x", "y"], ks), strict=True)]
    return spark.createDataFrame(out, "k int, bic double, aic double")


@query("m06_robust_scaling", "WITH q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM scores) SELECT event_id, round((score - b) / (c - a), 9) AS score FROM scores, q")
def _(spark, d):
    return O.robust_scaled(V.scores(spark, d), ["score"]).select("event_id", F.round("score", 9).alias("score"))


def _components_sql() -> str:
    """z = x - y makes the covariance singular, so a square root gives the other two eigenvalues, and a cross product of rows each one's vector."""
    out = f"""WITH {_TWO_SQL}, p AS (SELECT id, x, y, x - y AS z FROM t),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM p),
    e AS (SELECT *, xx + yy + zz AS tr, xx * yy - xy * xy + xx * zz - xz * xz + yy * zz - yz * yz AS minors FROM m),
    l AS (SELECT *, (tr + sqrt(tr * tr - 4 * minors)) / 2 AS l1, (tr - sqrt(tr * tr - 4 * minors)) / 2 AS l2 FROM e)"""
    for k in (1, 2):
        out += f""",
    v{k} AS (SELECT xy * yz - xz * (yy - l{k}) AS a, xz * xy - (xx - l{k}) * yz AS b, (xx - l{k}) * (yy - l{k}) - xy * xy AS c FROM l),
    u{k} AS (SELECT a / n * g AS a, b / n * g AS b, c / n * g AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN sign(a) WHEN abs(b) >= abs(c) THEN sign(b) ELSE sign(c) END AS g FROM v{k}))"""
    return out + " SELECT id, " + ", ".join(f"round((x - mx) * u{k}.a + (y - my) * u{k}.b + (z - mz) * u{k}.c, 6) AS pc{k}" for k in (1, 2)) + " FROM p, m, u1, u2"


@query("m07_principal_components", _components_sql())
def _(spark, d):
    rows = _two(spark, d).withColumn("z", F.col("x") - F.col("y"))
    means, comp, _var = O.principal_components(rows, ["x", "y", "z"], 2)
    return O.projected(rows, ["x", "y", "z"], means, comp).select("id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


_H = [[0.8, 0.05, 1.0], [-0.1, 0.6, 2.0], [0.001, 0.002, 1.0]]


@query("m09_homography_ransac", """WITH p AS (SELECT o_custkey AS customer, o_orderkey, (o_orderkey * 7919 % 1009) / 100 AS x, (o_orderkey * 15485863 % 997) / 100 AS y, o_orderkey % 9 = 4 AS moved FROM orders),
    q AS (SELECT *, 0.001 * x + 0.002 * y + 1 AS w FROM p), g AS (SELECT customer, count(*) AS pairs, count(*) FILTER (WHERE NOT moved) AS inliers, max(CASE WHEN moved THEN 3.0 + o_orderkey % 11 ELSE 0 END) AS worst,
        avg((0.8 * x + 0.05 * y + 1.0) / w) AS mean_u, avg((-0.1 * x + 0.6 * y + 2.0) / w) AS mean_v FROM q GROUP BY 1)
    SELECT customer, pairs, inliers, round(worst, 5) AS worst, round(mean_u, 5) AS mean_u, round(mean_v, 5) AS mean_v FROM g WHERE pairs >= 9 AND inliers >= 8""")
def _(spark, d):
    """A homography for each customer from its orders as point pairs, some of them misplaced by 3 and more: it is found, and tells those apart.

    mean_u, mean_v: the mean of the pairs' points under the homography that was found, which the twin takes from the true one.
    """
    o, key = V.table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("customer"), key.alias("n"), (key * 7919 % 1009 / 100).alias("x"), (key * 15485863 % 997 / 100).alias("y"))
    u, v = G.projected(_H, F.col("x"), F.col("y"))
    pairs = rows.withColumns({"u": u + F.when(F.col("n") % 9 == 4, 3.0 + F.col("n") % 11).otherwise(0.0), "v": v})
    found = O.homographies(pairs, "customer", ("x", "y"), ("u", "v"), 0.05, "n", least=9).where("inliers >= 8")
    h = F.col("h")
    w = h[6] * F.col("x") + h[7] * F.col("y") + h[8]
    back = rows.join(found, "customer").groupBy("customer", "pairs", "inliers", "max").agg(F.avg((h[0] * F.col("x") + h[1] * F.col("y") + h[2]) / w).alias("mean_u"), F.avg((h[3] * F.col("x") + h[4] * F.col("y") + h[5]) / w).alias("mean_v"))
    return back.select("customer", "pairs", "inliers", F.round("max", 5).alias("worst"), F.round("mean_u", 5).alias("mean_u"), F.round("mean_v", 5).alias("mean_v"))


def _windows(spark, d, values: list[str], rows):
    w = W.strided(rows, ["user_id", "event_type"], ["ts", "event_id"], 8, 4, values)
    return w.withColumn("start_index", F.col("start_index").cast("long"))


_KEYS = {"user_id": "long", "event_type": "string", "start_index": "long"}


@query("m10_macro_features")
def _(spark, d):
    rows = V.scores(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    w = _windows(spark, d, ["t", "score", "event_id"], rows)
    pick = lambda c, scale: F.transform("rows", lambda r: r[c].cast("double") / scale)
    w = w.select(*_KEYS, pick("t", 1).alias("t"), pick("score", 50).alias("x"), pick("event_id", 1000).alias("y"))
    return M.window_features(w, _KEYS)


@query("m10b_all_macro_features")
def _(spark, d):
    rows = V.scores(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    w = _windows(spark, d, ["t", "score", "event_id"], rows)
    pick = lambda c, scale: F.transform("rows", lambda r: F.when(r["event_id"] % 9 > 0, r[c].cast("double") / scale))
    w = w.select(*_KEYS, F.transform("rows", lambda r: r["t"].cast("double")).alias("t"), pick("score", 50).alias("x"), pick("event_id", 1000).alias("y"))
    return M.all_window_features(w, _KEYS)


def _poses(spark, d):
    """Windows of 17 made-up points with confidences: t and flat."""
    rows = V.scores(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    w = _windows(spark, d, ["t", "score", "event_id"], rows)
    point = lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.array(((r["score"] * (k + 1)) % 10) / 10 + (k % 5) / 5, ((r["event_id"] * (k + 3)) % 13) / 26 + k / 17, ((r["event_id"] + k * 7) % 10) / 10)))
    return w.select(*_KEYS, F.transform("rows", lambda r: r["t"].cast("double")).alias("t"), F.flatten(F.transform("rows", point)).alias("flat"))


@query("m11_pose_features")
def _(spark, d):
    return M.pose_windows(_poses(spark, d), _KEYS)


@query("m20_pose_energy")
def _(spark, d):
    return M.pose_energies(_poses(spark, d), _KEYS)


@query("j20_iou_tracks")
def _(spark, d):
    i = F.col("event_id")
    boxes = V.table(spark, d, "events").select((F.col("user_id") % 25).alias("camera"), F.floor(i / 40).alias("frame"), i.alias("det"), (F.col("value") % 50).alias("x1"), (F.col("user_id") % 7).cast("double").alias("y1"))
    boxes = boxes.withColumn("x2", F.col("x1") + 20).withColumn("y2", F.col("y1") + 20)
    return processors.tracks(boxes, processors.Tracker())
