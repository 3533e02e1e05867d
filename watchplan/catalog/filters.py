"""Queries of filters and projections (F-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog import streams as S
from watchplan.catalog.registry import query
from watchplan.operators import filters as O
from watchplan.operators.joins import small
from watchplan.plans import views as V
from watchplan.streaming import gates

NOW = "2024-01-31"


@query("f01_optional_conjunction", "SELECT id, camera_id, value FROM logs WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type = 'error' AND camera_id = 3")
def _(spark, d):
    return V.logs(spark, d).where(O.all_of([O.since("ts", NOW, 7), O.equals("event_type", "error"), O.equals("camera_id", 3), O.equals("authorized", None), O.at_hour("ts", None)])).select("id", "camera_id", "value")


@query("f02_name_tokens", "SELECT id FROM people WHERE coalesce(name ILIKE '%son 12%', false) OR coalesce(name ILIKE '%son%' , false) AND false OR coalesce(employee_name ILIKE '%0012%', false) OR coalesce(visitor_name ILIKE '%0012%', false) OR coalesce(name ILIKE '%0012%', false) OR coalesce(name ILIKE '%zz 0012%', false)")
def _(spark, d):
    return V.people(spark, d).where(O.all_of([O.any_of([O.named("zz 0012", ["employee_name", "visitor_name", "name"]), O.named("son 12", ["name"]) & F.col("name").ilike("%son 12%")])])).select("id")


@query("f03_calendar_day", "SELECT id FROM logs WHERE CAST(ts AS DATE) = DATE '2024-01-10'")
def _(spark, d):
    return V.logs(spark, d).where(O.on_day("ts", "2024-01-10")).select("id")


@query("f04_rolling_days", "SELECT id FROM logs WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAY")
def _(spark, d):
    return V.logs(spark, d).where(O.since("ts", NOW, 3)).select("id")


@query("f05_hour_of_day", "SELECT id FROM logs WHERE hour(ts) = 13")
def _(spark, d):
    return V.logs(spark, d).where(O.at_hour("ts", 13)).select("id")


@query("f06_known", "SELECT l.id, p.employee_name IS NOT NULL OR p.visitor_name IS NOT NULL OR p.name IS NOT NULL AS known, l.detected_id IS NOT NULL AS has_id FROM logs l LEFT JOIN people p ON l.detected_id = p.id")
def _(spark, d):
    p = small(V.people(spark, d).withColumnRenamed("id", "pid"))
    known = O.any_of(F.col(c).isNotNull() for c in ("employee_name", "visitor_name", "name"))
    return V.logs(spark, d).join(p, F.col("detected_id") == F.col("pid"), "left").select("id", known.alias("known"), F.col("detected_id").isNotNull().alias("has_id"))


@query("f07_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 42")
def _(spark, d):
    return V.table(spark, d, "events").where(F.get_json_object("props", "$.k") == "42").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("f08_latest_with_fallback", "SELECT id FROM cases WHERE coalesce(peak_ts, start_ts) >= TIMESTAMP '1998-01-01'")
def _(spark, d):
    return V.cases(spark, d).where(F.coalesce("peak_ts", "start_ts") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("id")


@query("f09_audit_filter", "SELECT id FROM cases WHERE priority ILIKE '%HIGH%' AND upper(status) = 'OPEN' AND start_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'")
def _(spark, d):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1997-01-01"))
    return V.cases(spark, d).where(O.all_of([F.col("priority").ilike("%HIGH%"), F.upper("status") == "OPEN", F.col("start_ts").between(lo, hi)])).select("id")


@query("f10_equality_lookups", "SELECT id, authorized FROM logs WHERE camera_id = 7 AND event_type = 'view' AND authorized")
def _(spark, d):
    return V.logs(spark, d).where(O.all_of([O.equals("camera_id", 7), O.equals("event_type", "view"), O.equals("authorized", True)])).select("id", "authorized")


@query("f11_label_search", "SELECT l.id FROM logs l LEFT JOIN people p ON l.detected_id = p.id LEFT JOIN cameras c ON l.camera_id = c.id WHERE contains(lower(coalesce(p.employee_name, p.visitor_name, p.name, 'Unknown')), '00012') OR contains(lower(coalesce(c.name, '')), '_12')")
def _(spark, d):
    p, c = V.people(spark, d).withColumnRenamed("id", "pid").withColumnRenamed("name", "person"), V.cameras(spark, d).withColumnRenamed("id", "cid")
    j = V.logs(spark, d).join(small(p), F.col("detected_id") == F.col("pid"), "left").join(small(c), F.col("camera_id") == F.col("cid"), "left")
    label = F.lower(F.coalesce("employee_name", "visitor_name", "person", F.lit("Unknown")))
    return j.where(label.contains("00012") | F.lower(F.coalesce("name", F.lit(""))).contains("_12")).select("id")


@query("f12_range_presets", """SELECT 'today' AS preset, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-30' UNION ALL SELECT '24h', count(*) FROM logs WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY
    UNION ALL SELECT '7d', count(*) FROM logs WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY UNION ALL SELECT '30d', count(*) FROM logs WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 DAY UNION ALL SELECT 'all', count(*) FROM logs""")
def _(spark, d):
    rows = V.logs(spark, d)
    one = rows.agg(*(F.count_if(O.all_of([O.preset("ts", "2024-01-30 12:00:00", p)])).alias(p) for p in O.PRESETS))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, O.PRESETS)), F.array(*(F.col(p) for p in O.PRESETS)))).alias("preset", "n"))


@query("f13_cleaning_report", "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT (value IS NULL OR value <= 20 OR k = 0 OR quality IS NULL)) AS kept, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE value <= 20) AS low, count(*) FILTER (WHERE k = 0) AS zero, count(*) FILTER (WHERE quality IS NULL) AS no_quality FROM logs")
def _(spark, d):
    return O.drop_counts(V.logs(spark, d), {"missing": F.col("value").isNull() | F.isnan("value"), "low": F.col("value") <= 20, "zero": F.col("k") == 0, "no_quality": F.col("quality").isNull()})


@query("f14_rejection_reasons", "SELECT id, list_filter([CASE WHEN value < 5 THEN 'small' END, CASE WHEN quality < 0.02 THEN 'blurred' END, CASE WHEN k > 90 THEN 'slow' END], lambda x: x IS NOT NULL) AS reasons, CASE WHEN value < 5 THEN 'small' WHEN quality < 0.02 THEN 'blurred' WHEN k > 90 THEN 'slow' END AS first_reason FROM logs")
def _(spark, d):
    rules = {"small": F.col("value") < 5, "blurred": F.col("quality") < 0.02, "slow": F.col("k") > 90}
    return V.logs(spark, d).select("id", O.reasons(rules).alias("reasons"), O.first_reason(rules).alias("first_reason"))


@query("f15_quality_suppression", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE coalesce(quality < 0.05, false) OR coalesce(margin < 0.05, false) OR k % 13 >= 10) AS suppressed FROM logs GROUP BY event_type")
def _(spark, d):
    bad = O.any_of(F.coalesce(x, F.lit(False)) for x in (F.col("quality") < 0.05, F.col("margin") < 0.05, F.col("k") % 13 >= 10))
    return V.logs(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("suppressed"))


_POSE = "event_id * 37 % 100 / 400 + 0.755 AS frames, CASE WHEN event_id % 17 > 0 THEN event_id * 13 % 100 / 250 + 0.602 END AS confidence, event_id * 7 % 100 / 300 + 0.701 AS keypoints, event_id % 5 AS ambiguous, CASE WHEN event_id % 4 > 0 THEN event_id % 9 END AS low_iou"


@query("f15b_gate_with_suppression", S.gate_sql(5.0, "").replace("FROM scores WINDOW", "FROM judged WINDOW").replace("WITH RECURSIVE ", f"""WITH RECURSIVE posed AS (SELECT scores.*, {_POSE} FROM scores),
    said AS (SELECT *, CASE WHEN frames < 0.85 THEN 'few_valid_frames' WHEN coalesce(confidence, 0) < 0.70 THEN 'low_confidence' WHEN keypoints < 0.80 THEN 'few_valid_keypoints' WHEN ambiguous >= 3 THEN 'ambiguous_poses' WHEN low_iou >= 3 THEN 'low_overlap' END AS reason FROM posed),
    judged AS (SELECT * FROM said WHERE reason IS NULL), """) + " SELECT track, seq, smooth, lasting, emits, NULL AS reason FROM g UNION ALL SELECT user_id || '/' || event_type, event_id, round(score, 7), false, false, reason FROM said WHERE reason IS NOT NULL")
def _(spark, d):
    """The gate of s02 over pose windows, with those of too poor a quality kept out of its state."""
    c, posed = F.col, S.samples(spark, d).withColumn("event_id", F.col("seq"))
    for p in _POSE.split(", "):
        posed = posed.withColumn(p.split(" AS ")[1], F.expr(p.split(" AS ")[0]))
    rows = posed.withColumn("reason", O.pose_quality(c("frames"), c("confidence"), c("keypoints"), c("ambiguous"), c("low_iou")))
    return gates.guarded(rows, gates.Gate(threshold=60.0, sigma=1.0)).withColumn("smooth", F.round("smooth", 7))


@query("f16_match_accept", "SELECT id, coalesce(similarity >= 0.62, false) AND coalesce(margin >= 0.03, true) AND coalesce(quality >= 0.1, true) AS accepted FROM logs")
def _(spark, d):
    return V.logs(spark, d).select("id", O.accepted(F.col("similarity"), F.col("margin"), F.col("quality"), (0.62, 0.03, 0.1)).alias("accepted"))


@query("f17_result_filters", "SELECT case_id, seq, part, supp FROM results WHERE gate = 'pose' AND upper(severity) = 'HIGH' AND contains(CAST(case_id AS VARCHAR), '12') AND threshold > 0")
def _(spark, d):
    return V.results(spark, d).where(O.all_of([O.equals("gate", "pose"), F.upper("severity") == "HIGH", F.col("case_id").cast("string").contains("12"), F.col("threshold") > 0])).select("case_id", "seq", "part", "supp")


@query("f18_enum_normalised", "SELECT CASE WHEN upper(trim(severity)) IN ('HIGH', 'CRITICAL') THEN upper(trim(severity)) ELSE 'UNKNOWN' END AS severity, count(*) AS n FROM results GROUP BY 1")
def _(spark, d):
    return V.results(spark, d).groupBy(O.one_of(F.col("severity"), ["HIGH", "CRITICAL"], "UNKNOWN").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("f19_clamped_limit", "SELECT id FROM logs ORDER BY ts DESC, id DESC LIMIT 200")
def _(spark, d):
    return V.logs(spark, d).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(O.clamp(5000, 50, 200)).select("id")
