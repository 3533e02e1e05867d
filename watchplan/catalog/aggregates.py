"""Queries of aggregates (A-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.operators import aggregates as O
from watchplan.operators import quantiles as Q
from watchplan.plans import views as V



@query("a01_filtered_counts", "SELECT count(*) FILTER (WHERE detected_id IS NULL) AS unknown, count(*) FILTER (WHERE detected_id IS NOT NULL) AS known, count(*) AS every FROM logs WHERE ts >= TIMESTAMP '2024-01-20'")
def _(spark, d):
    return V.logs(spark, d).where("ts >= timestamp_ntz'2024-01-20'").agg(F.count_if(F.col("detected_id").isNull()).alias("unknown"), F.count("detected_id").alias("known"), F.count(F.lit(1)).alias("every"))


@query("a02_people_seen_on_date", """SELECT p.id, coalesce(p.employee_name, p.visitor_name, p.name) AS person, CASE WHEN p.employee_name IS NOT NULL THEN 'employee' WHEN p.visitor_name IS NOT NULL THEN 'visitor' ELSE 'enrolled' END AS kind,
    count(*) AS seen, min(l.ts) AS first_seen, max(l.ts) AS last_seen, string_agg(DISTINCT coalesce(c.name, 'Camera ' || l.camera_id), ', ' ORDER BY coalesce(c.name, 'Camera ' || l.camera_id)) AS cameras
    FROM logs l JOIN people p ON l.detected_id = p.id LEFT JOIN cameras c ON l.camera_id = c.id WHERE CAST(l.ts AS DATE) = DATE '2024-01-15' GROUP BY ALL""")
def people_seen_on_date(spark, d, day: str = "2024-01-15"):
    """Who was seen on a day, by whom and where: the day's range is pushed to the scan, dimensions are broadcast."""
    from watchplan.operators.filters import on_day

    p = V.people(spark, d).withColumnRenamed("id", "pid")
    c = V.cameras(spark, d).select(F.col("id").alias("cid"), F.col("name").alias("camera"))
    rows = V.logs(spark, d).where(on_day("ts", day)).join(p, F.col("detected_id") == F.col("pid")).join(c, F.col("camera_id") == F.col("cid"), "left")
    kind = F.when(F.col("employee_name").isNotNull(), "employee").when(F.col("visitor_name").isNotNull(), "visitor").otherwise("enrolled")
    camera = F.coalesce("camera", F.concat(F.lit("Camera "), F.col("camera_id").cast("string")))
    return rows.groupBy(F.col("pid").alias("id"), F.coalesce("employee_name", "visitor_name", "name").alias("person"), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("seen"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_join(F.array_sort(F.collect_set(camera)), ", ").alias("cameras"))


@query("a03_camera_counts", "SELECT coalesce(c.name, 'Camera ' || l.camera_id) AS camera, count(*) AS n FROM logs l LEFT JOIN cameras c ON l.camera_id = c.id GROUP BY 1")
def _(spark, d):
    n = V.logs(spark, d).groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(V.cameras(spark, d), n["camera_id"] == F.col("id"), "left").select(F.coalesce("name", F.concat(F.lit("Camera "), F.col("camera_id").cast("string"))).alias("camera"), "n")


@query("a04_daily_summary", """SELECT a.*, b.* FROM (SELECT count(*) AS detections, count(*) FILTER (WHERE detected_id IS NULL) AS unknown, round(avg(quality), 3) AS avg_quality FROM logs WHERE CAST(ts AS DATE) = DATE '2024-01-15') a,
    (SELECT count(*) AS cases, count(CASE WHEN status = 'open' THEN 1 END) AS open_cases FROM cases) b""")
def _(spark, d):
    a = V.logs(spark, d).where("ts >= timestamp_ntz'2024-01-15' and ts < timestamp_ntz'2024-01-16'").agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("detected_id").isNull()).alias("unknown"), F.round(F.avg("quality"), 3).alias("avg_quality"))
    return a.crossJoin(V.cases(spark, d).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "open").alias("open_cases")))  # one row each


@query("a05_conditional_counts", "SELECT gate, count(*) FILTER (WHERE decision = 'YES') AS yes, count(*) FILTER (WHERE decision = 'NO') AS no, count(*) FILTER (WHERE decision IS NULL) AS failed, count(*) FILTER (WHERE upper(severity) = 'HIGH') AS high FROM results GROUP BY gate")
def _(spark, d):
    x = F.col("decision")
    return V.results(spark, d).groupBy("gate").agg(F.count_if(x == "YES").alias("yes"), F.count_if(x == "NO").alias("no"), F.count_if(x.isNull()).alias("failed"), F.count_if(F.upper("severity") == "HIGH").alias("high"))


@query("a06_distinct_identities", "SELECT count(DISTINCT detected_id) AS identities FROM logs")
def _(spark, d):
    return V.logs(spark, d).agg(F.count_distinct("detected_id").alias("identities"))


@query("a07_counts_per_identity", "SELECT p.id, (SELECT count(*) FROM logs l WHERE l.detected_id = p.id) AS total, (SELECT count(*) FROM logs l WHERE l.detected_id = p.id AND l.authorized) AS authorized FROM people p")
def _(spark, d):
    n = V.logs(spark, d).groupBy("detected_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("authorized")).alias("authorized"))
    p = V.people(spark, d).select("id")
    return p.join(n, p["id"] == n["detected_id"], "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("authorized", F.lit(0)).alias("authorized"))


@query("a08_seconds_since_last", "SELECT detected_id, CAST(floor(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts))) AS BIGINT) AS seconds FROM logs WHERE detected_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    gap = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))
    return V.logs(spark, d).where("detected_id is not null").groupBy("detected_id").agg(F.floor(gap / 1e6).cast("long").alias("seconds"))


@query("a09_rows_per_table", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def _(spark, d):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [V.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("events", "orders", "customer", "nation")])


@query("a10_two_groupings", "SELECT 'status' AS kind, status AS value, count(*) AS n FROM cases GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM cases GROUP BY 2")
def _(spark, d):
    # one scan: grouping sets
    n = V.cases(spark, d).groupingSets([["status"], ["severity"]], "status", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("g"))
    return n.select(F.when(F.col("g") == 0, "status").otherwise("severity").alias("kind"), F.coalesce("status", "severity").alias("value"), "n")


@query("a11_dominant_gate", "SELECT case_id, n, gate FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, CASE gate WHEN 'pose' THEN 0 WHEN 'deep' THEN 1 ELSE 2 END) AS r FROM (SELECT case_id, gate, count(*) AS n FROM results GROUP BY 1, 2)) WHERE r = 1")
def _(spark, d):
    n = V.results(spark, d).groupBy("case_id").agg(*(F.count_if(F.col("gate") == g).alias(g) for g in ("pose", "deep", "homography_macro")))
    best = F.greatest("pose", "deep", "homography_macro")
    return n.select("case_id", best.alias("n"), F.when(F.col("pose") == best, "pose").when(F.col("deep") == best, "deep").otherwise("homography_macro").alias("gate"))


@query("a12_gate_ratios", """WITH g(gate) AS (VALUES ('pose'), ('deep'), ('homography_macro'), ('audio')) SELECT g.gate, round(avg(CASE WHEN threshold > 0 THEN score / threshold END), 6) AS avg_ratio, max(CASE WHEN threshold > 0 THEN score / threshold END) AS max_ratio,
    max(ts) AS last_ts, coalesce(bool_or(decision = 'YES'), false) AS any_yes, count(r.gate) AS n FROM g LEFT JOIN results r ON r.gate = g.gate GROUP BY 1""")
def _(spark, d):
    ratio = F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold"))
    r = V.results(spark, d).groupBy("gate").agg(F.round(F.avg(ratio), 6).alias("avg_ratio"), F.max(ratio).alias("max_ratio"), F.max("ts").alias("last_ts"), F.bool_or(F.col("decision") == "YES").alias("any_yes"), F.count(F.lit(1)).alias("n"))
    return O.domain(spark, "gate", ["pose", "deep", "homography_macro", "audio"]).join(F.broadcast(r), "gate", "left").select("gate", "avg_ratio", "max_ratio", "last_ts", F.coalesce("any_yes", F.lit(False)).alias("any_yes"), F.coalesce("n", F.lit(0)).alias("n"))


@query("a13_rates", "SELECT gate, CAST(round_even(count(*) FILTER (WHERE decision = 'YES') * 100.0::DOUBLE / count(decision), 0) AS BIGINT) AS yes_rate, CAST(floor(count(*) FILTER (WHERE decision = 'YES') * 100.0::DOUBLE / count(decision) + 0.5) AS BIGINT) AS yes_rate_half_up FROM results GROUP BY 1")
def _(spark, d):
    yes, n = F.count_if(F.col("decision") == "YES"), F.count("decision")
    return V.results(spark, d).groupBy("gate").agg(O.percent(yes, n).alias("yes_rate"), F.floor(yes * 100.0 / n + 0.5).cast("long").alias("yes_rate_half_up"))


@query("a14_decision_histogram", "WITH dom(decision) AS (VALUES ('YES'), ('NO'), ('UNCERTAIN'), ('FAILED'), ('SKIPPED')) SELECT dom.decision, count(r.gate) AS n FROM dom LEFT JOIN (SELECT coalesce(decision, 'FAILED') AS decision, gate FROM results) r ON r.decision = dom.decision GROUP BY 1")
def _(spark, d):
    n = V.results(spark, d).groupBy(F.coalesce("decision", F.lit("FAILED")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))
    return O.zero_filled(n, spark, "decision", ["YES", "NO", "UNCERTAIN", "FAILED", "SKIPPED"])


@query("a15_evidence_health", "SELECT count(*) AS jobs, count(*) FILTER (WHERE len(list_filter(keys, lambda x: x LIKE '%2%')) > 0) AS any_two, CAST(sum(len(list_filter(keys, lambda x: x LIKE '%2%'))) AS BIGINT) AS twos FROM (SELECT case_id, list('k' || seq) AS keys FROM results GROUP BY 1)")
def _(spark, d):
    # counted from the lists' rows, which need not be gathered
    per = V.results(spark, d).groupBy("case_id").agg(F.count_if(F.concat(F.lit("k"), F.col("seq").cast("string")).contains("2")).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("m") > 0).alias("any_two"), F.sum("m").alias("twos"))


@query("a16_hour_histogram", "WITH h AS (SELECT unnest(range(24)) AS hour) SELECT CAST(h.hour AS INTEGER) AS hour, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'error') AS error FROM h LEFT JOIN (SELECT * FROM logs WHERE camera_id = 3 AND CAST(ts AS DATE) < DATE '2024-01-05') l ON hour(l.ts) = h.hour GROUP BY 1")
def _(spark, d):
    rows = V.logs(spark, d).where("camera_id = 3 and ts < timestamp_ntz'2024-01-05'")
    return O.zero_filled(O.histogram(rows, F.hour("ts"), "hour", "event_type", ["view", "error"]), spark, "hour", list(range(24)))


@query("a17_day_histogram", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'error') AS error FROM logs GROUP BY 1")
def _(spark, d):
    return O.histogram(V.logs(spark, d), F.to_date("ts"), "day", "event_type", ["view", "error"])


@query("a18_entry_metrics", "SELECT count(*) AS total, count(detected_id) AS known, count(*) - count(detected_id) AS unknown, round(count(detected_id) / count(*), 6) AS known_ratio, round(avg(coalesce(margin, 0)), 6) AS avg_margin, round(avg(coalesce(processing_ms, 0)), 6) AS avg_ms, round(avg(coalesce(quality, 0)), 6) AS avg_quality, round(avg(similarity), 6) AS avg_similarity FROM logs")
def _(spark, d):
    mean0 = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    return V.logs(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count("detected_id").alias("known"), (F.count(F.lit(1)) - F.count("detected_id")).alias("unknown"), F.round(F.count("detected_id") / F.count(F.lit(1)), 6).alias("known_ratio"), mean0("margin").alias("avg_margin"), mean0("processing_ms").alias("avg_ms"), mean0("quality").alias("avg_quality"), F.round(F.avg("similarity"), 6).alias("avg_similarity"))


@query("a19_camera_distribution", "SELECT camera_id, count(*) FILTER (WHERE detected_id IS NOT NULL) AS known, count(*) FILTER (WHERE detected_id IS NULL) AS unknown FROM logs GROUP BY 1")
def _(spark, d):
    return V.logs(spark, d).groupBy("camera_id").agg(F.count("detected_id").alias("known"), F.count_if(F.col("detected_id").isNull()).alias("unknown"))


@query("a20_quality_trend", "SELECT CAST(ts AS DATE) AS day, round(avg(quality) * 100, 2) AS quality FROM logs GROUP BY 1")
def _(spark, d):
    return V.logs(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("quality") * 100, 2).alias("quality"))


@query("a21_margin_bands", "SELECT CASE WHEN margin >= 0.2 THEN 'safe' WHEN margin >= 0.1 THEN 'warning' ELSE 'danger' END AS band, count(*) AS n FROM logs WHERE detected_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    band = F.when(F.col("margin") >= 0.2, "safe").when(F.col("margin") >= 0.1, "warning").otherwise("danger")
    return V.logs(spark, d).where("detected_id is not null").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("a22_pipeline_health", "SELECT count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'reviewing') AS reviewing, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE peak_ts IS NULL) AS without_peak FROM cases")
def _(spark, d):
    return V.cases(spark, d).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("open", "reviewing", "closed")), F.count_if(F.col("peak_ts").isNull()).alias("without_peak"))


_POINTS = [50.0, 90.0, 95.0, 99.0, 99.5]


@query("a24_percentile_thresholds", "SELECT event_type, p AS point, round(quantile_cont(score, 0.0) * 0 + CASE p WHEN 50 THEN quantile_cont(score, 0.5) WHEN 90 THEN quantile_cont(score, 0.9) WHEN 95 THEN quantile_cont(score, 0.95) WHEN 99 THEN quantile_cont(score, 0.99) ELSE quantile_cont(score, 0.995) END, 6) AS threshold FROM scores, (SELECT unnest([50.0::DOUBLE, 90.0, 95.0, 99.0, 99.5]) AS p) GROUP BY event_type, p")
def _(spark, d):
    return Q.percentiles(V.scores(spark, d), ["event_type"], "score", _POINTS).select("event_type", "point", F.round("threshold", 6).alias("threshold"))


_SWEEP = """WITH t AS (SELECT event_type, p AS point, CASE p WHEN 90 THEN quantile_cont(score, 0.9) ELSE quantile_cont(score, 0.6) END AS threshold FROM scores, (SELECT unnest([60.0::DOUBLE, 90.0]) AS p) GROUP BY event_type, p),
    r AS (SELECT s.*, t.point, t.threshold, s.score > t.threshold AS hit FROM scores s JOIN t ON s.event_type = t.event_type),
    i AS (SELECT *, row_number() OVER (PARTITION BY event_type, point, user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, point, user_id, hit ORDER BY ts, event_id) AS run FROM r),
    n AS (SELECT event_type, point, user_id, hit, run, count(*) AS n FROM i GROUP BY ALL)"""


@query("a25_threshold_sweep", _SWEEP + " SELECT event_type, point, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE hit), 0) AS BIGINT) AS hits, round(coalesce(sum(n) FILTER (WHERE hit), 0) * 100.0::DOUBLE / sum(n), 6) AS rate, coalesce(max(n) FILTER (WHERE hit), 0) AS longest FROM n GROUP BY 1, 2")
def _(spark, d):
    s = V.scores(spark, d)
    t = Q.percentiles(s, ["event_type"], "score", [60.0, 90.0])
    return O.sweep(s, ["event_type"], ["user_id"], ["ts", "event_id"], "score", t).select("event_type", "point", "rows", "hits", F.round("rate", 6).alias("rate"), "longest")


@query("a26_track_summary", "SELECT user_id, max(score) AS top, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.95), 9) AS p95, count(*) FILTER (WHERE score > 100) AS hits, bool_or(score > 100) AS any_hit, count(DISTINCT event_type) AS tracks, count(DISTINCT event_type) > 1 AS mixed FROM scores GROUP BY 1")
def _(spark, d):
    s, rows = F.col("score"), V.scores(spark, d)
    sums = rows.groupBy("user_id").agg(F.max(s).alias("top"), F.round(F.avg(s), 9).alias("mean"), F.count_if(s > 100).alias("hits"), F.bool_or(s > 100).alias("any_hit"), F.count_distinct("event_type").alias("tracks"), (F.count_distinct("event_type") > 1).alias("mixed"))
    return Q.with_percentiles(sums, rows, ["user_id"], "score", {"p95": 95.0}).withColumn("p95", F.round("p95", 9))


_CONF = "SELECT CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS part, value > 60 AS truth, quality > 0.1 AND k > 30 AS guess FROM logs WHERE quality IS NOT NULL"


@query("a27_confusion_metrics", f"""SELECT part, tp, tn, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr,
    round(coalesce(fn / nullif(fn + tp, 0), 0), 9) AS fnr, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
    FROM (SELECT part, count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn, count(*) FILTER (WHERE NOT truth AND guess) AS fp, count(*) FILTER (WHERE truth AND NOT guess) AS fn FROM ({_CONF}) GROUP BY part)""")
def _(spark, d):
    rows = V.logs(spark, d).where("quality is not null").withColumn("part", F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))
    c = O.confusion(rows, F.col("value") > 60, (F.col("quality") > 0.1) & (F.col("k") > 30), ["part"])
    return c.select("part", "tp", "tn", "fp", "fn", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "specificity", "fpr", "fnr", "accuracy", "f1")))


@query("a28_auroc_and_ap", """WITH r AS (SELECT event_type, value > 60 AS truth, k AS s FROM logs), g AS (SELECT event_type, s, count(*) FILTER (WHERE truth) AS p, count(*) FILTER (WHERE NOT truth) AS q FROM r GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(q) OVER (PARTITION BY event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g WINDOW w AS (PARTITION BY event_type ORDER BY s DESC))
    SELECT event_type, round(sum(p * (coalesce(below, 0) + q / 2)) / (sum(p) * sum(q)), 9) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 9) AS average_precision FROM c GROUP BY 1""")
def _(spark, d):
    rows = V.logs(spark, d).select("event_type", (F.col("value") > 60).alias("truth"), "k")
    return O.ranking_quality(rows, "truth", "k", ["event_type"]).select("event_type", F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


@query("a29_ks_distance", """WITH g AS (SELECT event_type, score, count(*) FILTER (WHERE user_id % 2 = 0) AS a, count(*) FILTER (WHERE user_id % 2 <> 0) AS b FROM scores GROUP BY 1, 2)
    SELECT event_type, round(max(gap), 9) AS ks FROM (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) - sum(b) OVER w / sum(b) OVER (PARTITION BY event_type)) AS gap FROM g WINDOW w AS (PARTITION BY event_type ORDER BY score)) GROUP BY 1""")
def _(spark, d):
    return O.ks_distance(V.scores(spark, d), F.col("user_id") % 2 == 0, "score", ["event_type"]).select("event_type", F.round("ks", 9).alias("ks"))


@query("a30_abs_correlation", "SELECT camera_id, round(CASE WHEN count(*) FILTER (WHERE value IS NOT NULL AND k IS NOT NULL) >= 3 AND stddev_pop(value) > 0 AND stddev_pop(k) > 0 THEN abs(corr(value, k)) END, 6) AS r FROM logs GROUP BY 1")
def _(spark, d):
    return V.logs(spark, d).groupBy("camera_id").agg(F.round(O.abs_correlation("value", "k"), 6).alias("r"))


@query("a31_describe", "SELECT event_type, count(score) AS count, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(stddev_pop(score), 6) AS std0, min(score) AS min, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q2, round(quantile_cont(score, 0.75), 6) AS q3, max(score) AS max FROM scores GROUP BY 1")
def _(spark, d):
    x = O.described(V.scores(spark, d), ["event_type"], "score")
    return x.select("event_type", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std", "std0")), "min", *(F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")), "max")


@query("a32_top_value_counts", "SELECT user_id || '/' || event_type AS key, count(*) AS n FROM scores GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(spark, d):
    return V.scores(spark, d).groupBy(F.concat_ws("/", "user_id", "event_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query("a33_pivot_mean", "SELECT user_id % 10 AS u, round(avg(score) FILTER (WHERE event_type = 'view'), 6) AS \"view\", round(avg(score) FILTER (WHERE event_type = 'click'), 6) AS click FROM scores GROUP BY 1")
def _(spark, d):
    p = V.scores(spark, d).groupBy((F.col("user_id") % 10).alias("u")).pivot("event_type", ["view", "click"]).agg(F.avg("score"))
    return p.select("u", F.round("view", 6).alias("view"), F.round("click", 6).alias("click"))


@query("a34_binned_histogram", "SELECT CAST(least(29, floor((score - lo) / ((hi - lo) / 30))) AS BIGINT) AS bin, count(*) AS n FROM scores, (SELECT min(score) AS lo, max(score) AS hi FROM scores) GROUP BY 1")
def _(spark, d):
    s = V.scores(spark, d)
    ends = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 30
    return s.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(29), F.floor((F.col("score") - F.col("lo")) / width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row


@query("a35_normal_operating_points", "WITH t AS (SELECT quantile_cont(score, 0.95) AS x FROM scores WHERE user_id < 100) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE score > x) AS hits FROM scores, t WHERE user_id >= 100 GROUP BY 1")
def _(spark, d):
    s = V.scores(spark, d)
    t = Q.percentiles(s.where("user_id < 100"), [], "score", [95.0]).select(F.col("threshold").alias("x"))
    return s.where("user_id >= 100").crossJoin(F.broadcast(t)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > F.col("x")).alias("hits"))


@query("a36_unread", "SELECT count(*) AS unread FROM logs WHERE authorized IS NULL")
def _(spark, d):
    return V.logs(spark, d).where("authorized is null").agg(F.count(F.lit(1)).alias("unread"))


@query("a37_split_summary", "SELECT CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'calibration' ELSE 'test' END AS split, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std0, round(quantile_cont(score, 0.99), 6) AS p99, round(quantile_cont(score, 0.995), 6) AS p99_5 FROM scores GROUP BY 1")
def _(spark, d):
    split = F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "calibration").otherwise("test")
    rows = V.scores(spark, d).withColumn("split", split)
    sums = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std0"))
    names = {O.percentile_key(p): p for p in (99.0, 99.5)}
    return Q.with_percentiles(sums, rows, ["split"], "score", names).select("split", "n", "mean", "std0", *(F.round(c, 6).alias(c) for c in names))
