"""Queries of ordered operators (W-*, S-2, S-3, S-7 in batch form)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.operators import chunks as C
from watchplan.operators import motion as M
from watchplan.operators import windows as O
from watchplan.operators.motion import savgol_weights
from watchplan.plans import views as V

BY, ORDER = ["user_id", "event_type"], ["ts", "event_id"]
_W = "(PARTITION BY user_id, event_type ORDER BY ts, event_id"
_ALL = f"WINDOW w AS {_W}), f AS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _causal_sql(sigma: float) -> str:
    x = O.weights(sigma, math.ceil(3 * sigma))
    lag = lambda k: f"lag(score, {k}) OVER w" if k else "score"
    top = " + ".join(f"coalesce({lag(k)} * {v!r}::DOUBLE, 0)" for k, v in enumerate(x))
    return f"({top}) / (" + " + ".join(f"CASE WHEN {lag(k)} IS NOT NULL THEN {v!r}::DOUBLE ELSE 0 END" for k, v in enumerate(x)) + ")"


def _centred_sql(sigma: float, radius: int, least: int) -> str:
    x = O.weights(sigma, radius)
    total = x[0] + 2 * sum(x[1:])
    terms = [f"score * {x[0] / total!r}::DOUBLE"] + [f"(coalesce(lag(score, {k}) OVER w, first_value(score) OVER f) + coalesce(lead(score, {k}) OVER w, last_value(score) OVER f)) * {x[k] / total!r}::DOUBLE" for k in range(1, radius + 1)]
    return f"CASE WHEN count(score) OVER f < {least} THEN score ELSE {' + '.join(terms)} END"


@query("w01_causal_gaussian", f"SELECT event_id, round({_causal_sql(2.0)}, 8) AS smooth FROM scores WINDOW w AS {_W})")
def _(spark, d):
    return V.scores(spark, d).select("event_id", F.round(O.causal_gaussian("score", O.track(BY, ORDER), 2.0), 8).alias("smooth"))


@query("w02_centred_gaussian", f"SELECT event_id, round({_centred_sql(1.0, 3, 3)}, 8) AS smooth FROM scores {_ALL}")
def _(spark, d):
    return V.scores(spark, d).select("event_id", F.round(O.centred_gaussian("score", BY, O.track(BY, ORDER), 1.0, round(3 * 1.0)), 8).alias("smooth"))


@query("w03_centred_gaussian_wide", f"SELECT event_id, round({_centred_sql(1.5, 6, 1)}, 8) AS smooth FROM scores {_ALL}")
def _(spark, d):
    return V.scores(spark, d).select("event_id", F.round(O.centred_gaussian("score", BY, O.track(BY, ORDER), 1.5, int(4 * 1.5 + 0.5), least=1), 8).alias("smooth"))


_HITS = f"SELECT *, score > 60 AS hit, sum(CASE WHEN score > 60 THEN 1 ELSE 0 END) OVER {_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS lasting FROM scores"


def _chunk():
    return C.by_time("ts", 864000.0)  # a track's rows of ten days are one task's


def _lasting(spark, d):
    rows = V.scores(spark, d).withColumn("hit", F.col("score") > 60)
    return C.persistent(rows, BY, ORDER, "hit", 3, 5, _chunk(), "lasting")


@query("w04_persistence", f"SELECT event_id, lasting FROM ({_HITS})")
def _(spark, d):
    return _lasting(spark, d).select("event_id", "lasting")


@query("w05_persistence_current_hit", f"SELECT event_id, lasting AND hit AS lasting FROM ({_HITS})")
def _(spark, d):
    rows = V.scores(spark, d).withColumn("hit", F.col("score") > 60)
    return C.persistent(rows, BY, ORDER, "hit", 3, 5, _chunk(), "lasting", now_too=True).select("event_id", "lasting")


@query("w06_cooldown_events", f"""WITH RECURSIVE h AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS tm, row_number() OVER {_W}) AS n FROM scores WHERE score > 60),
    r AS (SELECT user_id, event_type, event_id, n, tm AS last, true AS emit FROM h WHERE n = 1
          UNION ALL SELECT h.user_id, h.event_type, h.event_id, h.n, CASE WHEN h.tm - r.last >= 172800000000 THEN h.tm ELSE r.last END, h.tm - r.last >= 172800000000
          FROM r JOIN h ON h.user_id = r.user_id AND h.event_type = r.event_type AND h.n = r.n + 1) SELECT user_id, event_type, event_id FROM r WHERE emit""")
def _(spark, d):
    hits = V.scores(spark, d).where("score > 60").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return O.cooldown(hits, BY, ["at", "event_id"], "at", 172800.0, "event_id", "user_id long, event_type string")


@query("w07_gap_sessions", f"""WITH h AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) <= 86400000000 THEN 0 ELSE 1 END AS new FROM scores WHERE score > 60),
    s AS (SELECT *, sum(new) OVER {_W}) AS session FROM h) SELECT user_id, event_type, min(ts) AS start, max(ts) AS "end", count(*) AS rows, max(score) AS top, round(avg(score), 9) AS mean FROM s GROUP BY user_id, event_type, session""")
def _(spark, d):
    s = C.gap_sessions(V.scores(spark, d).where("score > 60"), BY, ORDER, "ts", 86400.0, "score", _chunk())
    return s.select(*BY, "start", "end", "rows", "top", F.round("mean", 9).alias("mean"))


@query("w08_rising_edges", f"SELECT event_id FROM (SELECT event_id, lasting AND NOT coalesce(lag(lasting) OVER {_W}), false) AS rises FROM ({_HITS})) WHERE rises")
def _(spark, d):
    return C.rising_edges(_lasting(spark, d), BY, ORDER, "lasting", _chunk(), "rises").where("rises").select("event_id")


@query("w09_longest_run", f"""WITH h AS ({_HITS}), i AS (SELECT user_id, event_type, hit, row_number() OVER {_W}) - row_number() OVER (PARTITION BY user_id, event_type, hit ORDER BY ts, event_id) AS run FROM h),
    n AS (SELECT user_id, event_type, hit, run, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, event_type, coalesce(max(n) FILTER (WHERE hit), 0) AS longest FROM n GROUP BY 1, 2""")
def _(spark, d):
    return C.longest_run(V.scores(spark, d).withColumn("hit", F.col("score") > 60), BY, ORDER, "hit", _chunk())


@query("w10_strided_windows", f"""SELECT user_id, event_type, start_index, ids, total FROM (SELECT user_id, event_type, row_number() OVER {_W}) - 8 AS start_index, list(event_id) OVER {_W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ids,
    round(sum(score) OVER {_W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS total FROM scores) WHERE start_index >= 0 AND start_index % 3 = 0""")
def _(spark, d):
    s = O.strided(V.scores(spark, d), BY, ORDER, 8, 3, ["event_id", "score"])
    total = F.aggregate("rows", F.lit(0.0), lambda a, x: a + x["score"])
    return s.select(*BY, F.col("start_index").cast("long").alias("start_index"), F.transform("rows", lambda r: r["event_id"]).alias("ids"), F.round(total, 6).alias("total"))


@query("w10a_live_stride", f"""WITH RECURSIVE h AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM scores),
    r AS (SELECT user_id, event_type, event_id, n, CAST(NULL AS BIGINT) AS last, false AS emit FROM h WHERE n = 1 UNION ALL
          SELECT h.user_id, h.event_type, h.event_id, h.n, CASE WHEN h.n >= 8 AND (r.last IS NULL OR h.event_id - r.last >= 200) THEN h.event_id ELSE r.last END, h.n >= 8 AND (r.last IS NULL OR h.event_id - r.last >= 200)
          FROM r JOIN h ON h.user_id = r.user_id AND h.event_type = r.event_type AND h.n = r.n + 1) SELECT user_id, event_type, event_id FROM r WHERE emit""")
def _(spark, d):
    return O.strided_by_gap(V.scores(spark, d).withColumn("index", F.col("event_id")), BY, ["index", "event_id"], "index", 8, 200, "event_id", "user_id long, event_type string")


@query("w11_track_segments", f"SELECT event_id, CAST(sum(new) OVER {_W}) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN event_id - lag(event_id) OVER {_W}) <= 501 THEN 0 ELSE 1 END AS new FROM scores)")
def _(spark, d):
    return O.segments(V.scores(spark, d), BY, ORDER, "event_id", 500).select("event_id", F.col("segment").cast("long").alias("segment"))


@query("w12_lag_deltas", f"SELECT event_id, round(score - lag(score) OVER {_W}), 9) AS step, round(CASE WHEN lag(score) OVER {_W}) IS NULL THEN 1 ELSE least(score, lag(score) OVER {_W})) / greatest(score, lag(score) OVER {_W})) END, 9) AS overlap FROM scores")
def _(spark, d):
    before = F.lag("score").over(O.track(BY, ORDER))
    overlap = F.when(before.isNull(), F.lit(1.0)).otherwise(F.least("score", before) / F.greatest("score", before))
    return V.scores(spark, d).select("event_id", F.round(F.col("score") - before, 9).alias("step"), F.round(overlap, 9).alias("overlap"))


@query("w13_carried_observation", f"""SELECT event_id, CASE WHEN event_id - last_value(tm IGNORE NULLS) OVER w <= 2000 THEN last_value(v IGNORE NULLS) OVER w END AS carried
    FROM (SELECT *, CASE WHEN score > 50 THEN score END AS v, CASE WHEN score > 50 THEN event_id END AS tm FROM scores) WINDOW w AS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    rows = V.scores(spark, d).withColumn("v", F.when(F.col("score") > 50, F.col("score")))
    return rows.select("event_id", O.carried("v", "event_id", O.track(BY, ORDER), 2000).alias("carried"))


@query("w14_null_repair", f"""SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v
    FROM (SELECT *, CASE WHEN score > 50 THEN score END AS v FROM scores)""")
def _(spark, d):
    rows = V.scores(spark, d).withColumn("v", F.when(F.col("score") > 50, F.col("score")))
    return rows.select("event_id", O.repaired("v", O.track(BY, ORDER)).alias("v"))


@query("w15_median_filter", f"""SELECT event_id, round(list_median, 9) AS smooth FROM (SELECT event_id, list_aggregate(list(score) OVER {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 'median') AS list_median FROM scores)""")
def _(spark, d):
    frame = O.track(BY, ORDER).rowsBetween(-2, 2)
    s = F.array_sort(F.collect_list("score").over(frame))
    n = F.size(s)
    mid = (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, ((n + 2) / 2).cast("int"))) / 2
    return V.scores(spark, d).select("event_id", F.round(mid, 9).alias("smooth"))


def _savgol_sql() -> str:
    x = savgol_weights(5, 2)
    near = lambda k: "score" if not k else f"lead(score, {k}) OVER w" if k > 0 else f"lag(score, {-k}) OVER w"
    rows = [" + ".join(f"{near(m - j)} * {float(x[j, m])!r}::DOUBLE" for m in range(5)) for j in range(5)]
    return f"CASE WHEN n < 5 THEN score WHEN i = 0 THEN {rows[0]} WHEN i = 1 THEN {rows[1]} WHEN i = n - 1 THEN {rows[4]} WHEN i = n - 2 THEN {rows[3]} ELSE {rows[2]} END"


@query("w15b_savgol", f"SELECT event_id, round({_savgol_sql()}, 7) AS smooth FROM (SELECT *, row_number() OVER {_W}) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM scores) WINDOW w AS {_W})")
def _(spark, d):
    from pyspark.sql import Window

    w = O.track(BY, ORDER)
    rows = V.scores(spark, d).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*BY)))
    return rows.select("event_id", F.round(M.savgol_column("score", w, F.col("_i"), F.col("_n")), 7).alias("smooth"))


#: Boxes made up from events, a track's one after another.
_BOX = "SELECT event_id, user_id, event_type, ts, value % 50 AS x1, user_id % 7 + value / 10 AS y1, value % 50 + 20 + event_id % 5 AS x2, user_id % 7 + value / 10 + 30 + event_id % 7 AS y2 FROM events"
_SIDES = ("x1", "y1", "x2", "y2")


def _boxes(spark, d):
    e, v, i = V.table(spark, d, "events"), F.col("value"), F.col("event_id")
    x1, y1 = v % 50, F.col("user_id") % 7 + v / 10
    return e.select(i.alias("event_id"), "user_id", "event_type", "ts", x1.alias("x1"), y1.alias("y1"), (x1 + 20 + i % 5).alias("x2"), (y1 + 30 + i % 7).alias("y2"))


_STABLE = f"""b AS ({_BOX}), c AS (SELECT *, greatest(1.0, x2 - x1) AS bw, greatest(1.0, y2 - y1) AS bh FROM b), m AS (SELECT *, x1 + bw / 2 AS cx, y1 + bh / 2 AS cy FROM c),
    s AS (SELECT *, median(cx) OVER f AS s_cx, median(cy) OVER f AS s_cy, median(bw) OVER f AS s_bw, median(bh) OVER f AS s_bh FROM m WINDOW f AS {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query("m12_stable_boxes", f"WITH {_STABLE} SELECT event_id, round(s_cx, 7) AS cx, round(s_cy, 7) AS cy, round(s_bw, 7) AS bw, round(s_bh, 7) AS bh FROM s")
def _(spark, d):
    s = M.stabilised(_boxes(spark, d), BY, O.track(BY, ORDER), _SIDES)
    return s.select("event_id", *(F.round(f"s_{c}", 7).alias(c) for c in ("cx", "cy", "bw", "bh")))


@query("m12_box_jitter", f"""WITH {_STABLE}, j AS (SELECT user_id, event_type, bw, bh, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2) AS a, sqrt((s_cx - lag(s_cx) OVER w) ** 2 + (s_cy - lag(s_cy) OVER w) ** 2) AS b,
    abs(bw * bh - lag(bw * bh) OVER w) / lag(bw * bh) OVER w AS c FROM s WINDOW w AS {_W}))
    SELECT user_id, event_type, round(coalesce(quantile_cont(a, 0.95), 0) + 1e-10, 6) AS centre_raw, round(coalesce(quantile_cont(b, 0.95), 0) + 1e-10, 6) AS centre_smooth, round(coalesce(quantile_cont(c, 0.95), 0) + 1e-10, 6) AS size_change, round(stddev_pop(bw) / avg(bw) + 1e-10, 6) AS width_cv, round(stddev_pop(bh) / avg(bh) + 1e-10, 6) AS height_cv FROM j GROUP BY 1, 2""")
def _(spark, d):
    w = O.track(BY, ORDER)
    j = M.jitter(M.stabilised(_boxes(spark, d), BY, w, _SIDES), BY, w)
    return j.select(*BY, *(F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("centre_raw", "centre_smooth", "size_change", "width_cv", "height_cv")))


@query("m20_box_transitions", f"""WITH b AS (SELECT *, greatest(1.0, x2 - x1) AS bw, greatest(1.0, y2 - y1) AS bh, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ({_BOX})),
    p AS (SELECT *, lag(bw) OVER w AS pw, lag(bh) OVER w AS ph, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM b WINDOW w AS {_W}))
    SELECT event_id, round(CASE WHEN pw IS NULL THEN 0 ELSE sqrt((cx - px) ** 2 + (cy - py) ** 2) / greatest(1.0, sqrt(pw * pw + ph * ph)) + 0.5 * (abs(bw - pw) / pw + abs(bh - ph) / ph) + 0.25 * abs(bw / bh - pw / ph) END, 7) AS change FROM p""")
def _(spark, d):
    return _boxes(spark, d).select("event_id", F.round(M.box_transition(_SIDES, O.track(BY, ORDER)), 7).alias("change"))


@query("m20_trajectory_change", f"""WITH p AS (SELECT event_id, x1 - lag(x1) OVER w AS dx, y1 - lag(y1) OVER w AS dy, lag(x1) OVER w - lag(x1, 2) OVER w AS ex, lag(y1) OVER w - lag(y1, 2) OVER w AS ey FROM ({_BOX}) WINDOW w AS {_W})),
    q AS (SELECT *, sqrt(dx * dx + dy * dy) AS s, sqrt(ex * ex + ey * ey) AS e FROM p)
    SELECT event_id, round(CASE WHEN s IS NULL THEN 0 WHEN e IS NULL THEN s ELSE s + sqrt((dx - ex) ** 2 + (dy - ey) ** 2) + CASE WHEN s > 1e-9 AND e > 1e-9 THEN acos(least(1.0, greatest(-1.0, (dx * ex + dy * ey) / (s * e)))) ELSE 0 END END, 6) AS change FROM q""")
def _(spark, d):
    return _boxes(spark, d).select("event_id", F.round(M.trajectory_change("x1", "y1", O.track(BY, ORDER)), 6).alias("change"))


_USER = "(PARTITION BY user_id ORDER BY ts, event_id)"
_KEY_FRAMES = f"""WITH RECURSIVE b AS (SELECT *, greatest(1.0, x2 - x1) AS bw, greatest(1.0, y2 - y1) AS bh, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ({_BOX})),
    p AS (SELECT *, row_number() OVER w - 1 AS i, lag(bw) OVER w AS pw, lag(bh) OVER w AS ph, lag(cx) OVER w AS px, lag(cy) OVER w AS py, x1 - lag(x1) OVER w AS dx, y1 - lag(y1) OVER w AS dy, lag(x1) OVER w - lag(x1, 2) OVER w AS ex, lag(y1) OVER w - lag(y1, 2) OVER w AS ey FROM b WINDOW w AS {_USER}),
    q AS (SELECT *, sqrt(dx * dx + dy * dy) AS s, sqrt(ex * ex + ey * ey) AS e FROM p),
    f AS (SELECT user_id, i, event_id % 10 / 10 AS energy, event_id % 4 / 4 AS image,
        round(CASE WHEN pw IS NULL THEN 0 ELSE sqrt((cx - px) ** 2 + (cy - py) ** 2) / greatest(1.0, sqrt(pw * pw + ph * ph)) + 0.5 * (abs(bw - pw) / pw + abs(bh - ph) / ph) + 0.25 * abs(bw / bh - pw / ph) END, 6) AS box,
        round(CASE WHEN s IS NULL THEN 0 WHEN e IS NULL THEN s ELSE s + sqrt((dx - ex) ** 2 + (dy - ey) ** 2) + CASE WHEN s > 1e-9 AND e > 1e-9 THEN acos(least(1.0, greatest(-1.0, (dx * ex + dy * ey) / (s * e)))) ELSE 0 END END, 6) AS trajectory FROM q),
    g AS (SELECT user_id * 100000 + i // 16 AS event, any_value(user_id) AS user_id, CASE WHEN (i // 16) % 3 = 2 THEN 6 ELSE 16 END AS total, list(energy ORDER BY i)[2:16] AS energy, list(box ORDER BY i)[2:16] AS box, list(image ORDER BY i)[2:16] AS image, list(trajectory ORDER BY i)[2:16] AS trajectory FROM f GROUP BY user_id, i // 16 HAVING count(*) = 16),
    n AS (SELECT event, total, CASE user_id % 5 WHEN 0 THEN 'deep' WHEN 1 THEN 'pose' WHEN 2 THEN 'homography_macro' WHEN 3 THEN 'pose' END AS gate, CASE WHEN user_id % 5 = 3 OR user_id % 2 = 0 THEN NULL ELSE energy END AS energy, CASE WHEN user_id % 5 = 3 AND user_id % 3 = 0 THEN NULL ELSE box END AS box, image, CASE WHEN user_id % 3 > 0 THEN trajectory END AS trajectory FROM g),
    c AS (SELECT event, total, gate, CASE WHEN gate IS NULL OR total <= 8 THEN NULL WHEN gate = 'deep' THEN image WHEN gate = 'homography_macro' THEN trajectory WHEN energy IS NOT NULL THEN energy WHEN list_max(box) > 0 THEN box ELSE image END AS x,
        CASE WHEN gate = 'deep' THEN 'image' WHEN gate = 'homography_macro' THEN 'trajectory' WHEN energy IS NOT NULL THEN 'energy' WHEN list_max(box) > 0 THEN 'box' ELSE 'image' END AS basis FROM n),
    v AS (SELECT event, total, gate, CASE WHEN gate = 'pose' AND NOT coalesce(list_max(x) > 0, false) THEN NULL ELSE x END AS x, CASE WHEN gate IS NULL THEN 'unknown_gate' WHEN total <= 8 THEN 'all_frames' WHEN gate = 'homography_macro' AND x IS NULL THEN 'no_trajectory' WHEN gate = 'pose' AND NOT coalesce(list_max(x) > 0, false) THEN 'nothing_moves' ELSE basis END AS basis FROM c),
    o AS (SELECT event, t, row_number() OVER (PARTITION BY event ORDER BY score DESC, t DESC) AS k FROM (SELECT event, unnest(x) AS score, unnest(range(1, len(x) + 1)) AS t FROM v WHERE x IS NOT NULL) WHERE score > 0),
    r AS (SELECT event, 0::BIGINT AS k, [0, 15]::BIGINT[] AS kept, []::BIGINT[] AS used FROM v WHERE x IS NOT NULL UNION ALL
          SELECT r.event, o.k, CASE WHEN skip THEN r.kept ELSE list_concat(r.kept, list_filter([o.t - 1, o.t, o.t + 1], lambda y: y BETWEEN 0 AND 15 AND NOT list_contains(r.kept, y))[1:8 - len(r.kept)]) END, CASE WHEN skip THEN r.used ELSE list_append(r.used, o.t) END
          FROM (SELECT r.*, o.t, len(r.kept) >= 8 OR len(list_filter(r.used, lambda y: abs(y - o.t) <= 1)) > 0 AS skip FROM r JOIN o ON o.event = r.event AND o.k = r.k + 1) r JOIN o ON o.event = r.event AND o.k = r.k + 1),
    l AS (SELECT event, arg_max(kept, k) AS kept FROM r GROUP BY 1),
    even AS (SELECT list(DISTINCT CAST(round_even(i * 15 / 7.0::DOUBLE, 0) AS BIGINT)) AS e FROM range(8) z(i)),
    m AS (SELECT event, list_concat(kept, list_sort(list_filter(e, lambda y: NOT list_contains(kept, y)))[1:8 - len(kept)]) AS kept FROM l, even),
    w AS (SELECT event, list_concat(kept, list_filter(range(16), lambda y: NOT list_contains(kept, y))[1:8 - len(kept)]) AS kept FROM m)
    SELECT v.event, v.total, v.basis, CASE WHEN v.basis IN ('unknown_gate', 'no_trajectory', 'nothing_moves') THEN 'even_spacing' ELSE v.gate END AS selector, CASE WHEN v.total <= 8 THEN range(v.total) WHEN v.x IS NULL THEN list_sort(e) ELSE list_sort(w.kept) END AS frames
    FROM v CROSS JOIN even LEFT JOIN w ON w.event = v.event"""


@query("t10b_key_frames", _KEY_FRAMES)
def _(spark, d):
    from watchplan.operators import ranking as R

    w, i, user = O.track(["user_id"], ORDER), F.col("event_id"), F.col("user_id")
    rows = _boxes(spark, d).withColumns({"box": F.round(M.box_transition(_SIDES, w), 6), "trajectory": F.round(M.trajectory_change("x1", "y1", w), 6), "energy": i % 10 / 10, "image": i % 4 / 4})
    windows = O.strided(rows, ["user_id"], ORDER, 16, 16, ["energy", "box", "image", "trajectory"])
    of = lambda c: F.slice(F.transform("rows", lambda r: r[c]), 2, 15)
    five, none = user % 5, F.lit(None).cast("array<double>")
    number = F.floor(F.col("start_index") / 16)
    events = windows.select(
        (user * 100000 + number).alias("event"), F.when(five == 0, "deep").when(five == 1, "pose").when(five == 2, "homography").when(five == 3, "Pose ").otherwise("other").alias("gate"), F.when(number % 3 == 2, 6).otherwise(16).alias("total"),
        F.when((five == 3) | (user % 2 == 0), none).otherwise(of("energy")).alias("energy"), F.when((five == 3) & (user % 3 == 0), none).otherwise(of("box")).alias("box"), of("image").alias("image"), F.when(user % 3 > 0, of("trajectory")).alias("trajectory"),
    )
    return R.key_frames(events, "event").select("event", "total", "basis", "selector", "frames")


_ANKLES = "CASE WHEN event_id % 3 > 0 THEN x1 END AS lx, y1 AS ly, event_id % 10 / 10 AS lconf, x2 AS rx, CASE WHEN event_id % 7 > 0 THEN y1 + 1 END AS ry, event_id % 11 / 20 AS rconf, (x1 + x2) / 2 AS bx, y2 AS by_"


@query("w13b_ground_points", f"""WITH RECURSIVE h AS (SELECT user_id, event_id, {_ANKLES}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({_BOX})),
    g AS (SELECT *, lx IS NOT NULL AND lconf >= 0.8 AS l, ry IS NOT NULL AND rconf >= 0.8 AS r FROM (SELECT * REPLACE (2 * rconf AS rconf) FROM h)),
    p AS (SELECT user_id, event_id, n, bx, by_, CASE WHEN l AND r THEN (lx + rx) / 2 WHEN l THEN lx WHEN r THEN rx END AS ax, CASE WHEN l AND r THEN (ly + ry) / 2 WHEN l THEN ly WHEN r THEN ry END AS ay, CASE WHEN l AND r THEN 'ankle_midpoint' WHEN l OR r THEN 'single_ankle' END AS said FROM g),
    s AS (SELECT user_id, event_id, n, event_id AS last, coalesce(ax, bx) AS x, coalesce(ay, by_) AS y, coalesce(said, 'bbox_bottom') AS source FROM p WHERE n = 1 UNION ALL
          SELECT user_id, event_id, n, CASE WHEN held THEN last ELSE event_id END, CASE WHEN held THEN x ELSE coalesce(ax, bx) END, CASE WHEN held THEN y ELSE coalesce(ay, by_) END, CASE WHEN held THEN 'freeze_last_valid' ELSE coalesce(said, 'bbox_bottom') END
          FROM (SELECT p.*, s.last, s.x, s.y, said IS NULL AND p.event_id - s.last <= 300 AS held FROM s JOIN p ON p.user_id = s.user_id AND p.n = s.n + 1))
    SELECT event_id, round(x, 6) AS x, round(y, 6) AS y, source FROM s""")
def _(spark, d):
    rows = _boxes(spark, d).selectExpr("user_id", "event_id", _ANKLES.split(" AS lx")[0] + " AS lx", *(p.strip() for p in _ANKLES.split(" AS lx, ")[1].split(", "))).withColumn("rconf", 2 * F.col("rconf"))
    out = O.ground_points(rows, ["user_id"], "event_id", "user_id long", least=0.8, most_age=300)
    return out.select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "source")


@query("w16_first_seen_order", f"SELECT user_id, list(event_type ORDER BY tm, event_type) AS seen FROM (SELECT user_id, event_type, min(ts) AS tm FROM scores GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    first = V.scores(spark, d).groupBy("user_id", "event_type").agg(F.min("ts").alias("at"))
    kinds = F.sort_array(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("user_id").agg(kinds.alias("k")).select("user_id", F.transform("k", lambda x: x["event_type"]).alias("seen"))


@query("w18_last_points", "SELECT event_id, ts, score FROM (SELECT * FROM scores ORDER BY ts DESC, event_id DESC LIMIT 200) ORDER BY ts")
def _(spark, d):
    return V.scores(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts", "score").orderBy("ts", "event_id")


@query("s07_debounced", f"""WITH RECURSIVE h AS (SELECT user_id, event_type, event_id, score > 40 AS hit, row_number() OVER {_W}) AS n FROM scores),
    r AS (SELECT user_id, event_type, event_id, n, CASE WHEN hit THEN 1 ELSE 0 END AS level, false AS fires FROM h WHERE n = 1 UNION ALL
          SELECT h.user_id, h.event_type, h.event_id, h.n, CASE WHEN h.hit THEN CASE WHEN r.level + 1 >= 4 THEN 0 ELSE r.level + 1 END ELSE greatest(0, r.level - 1) END, h.hit AND r.level + 1 >= 4
          FROM r JOIN h ON h.user_id = r.user_id AND h.event_type = r.event_type AND h.n = r.n + 1) SELECT user_id, event_type, event_id FROM r WHERE fires""")
def _(spark, d):
    rows = V.scores(spark, d).withColumn("hit", F.col("score") > 40).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return O.debounced(rows, BY, ["at", "event_id"], "hit", 4, "event_id", "user_id long, event_type string")


@query("s09_immobile", """SELECT event_id, max(value) OVER w - min(value) OVER w < 10 AND count(*) OVER w > 1 AS still FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-7_200_000_000, 0)
    return V.table(spark, d, "events").select("event_id", ((F.max("value").over(w) - F.min("value").over(w) < 10) & (F.count(F.lit(1)).over(w) > 1)).alias("still"))
