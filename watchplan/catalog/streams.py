"""Batch twins of the streaming operators (S-*); their SQL goes from row to row by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.operators.windows import weights
from watchplan.plans import views as V
from watchplan.streaming import alerts, gates, processors

GATE = gates.Gate(threshold=60.0, sigma=1.0, cooldown=86400.0)
TUBELETS = gates.Tubelets(length=6, stride=400, stale=600)
_BY = "PARTITION BY user_id, event_type ORDER BY event_id"


def samples(spark, d):
    e = V.scores(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select(F.concat_ws("/", "user_id", "event_type").alias("track"), F.col("event_id").alias("seq"), "at", "score")


def gate_sql(cooldown: float, out: str) -> str:
    """Smoothing and persistence as windows; only what emits goes from one edge to the next."""
    lag = lambda k: f"lag(score, {k}) OVER w" if k else "score"
    x = weights(1.0, 3)
    smooth = "(" + " + ".join(f"coalesce({lag(k)} * {v!r}::DOUBLE, 0)" for k, v in enumerate(x)) + ") / (" + " + ".join(f"CASE WHEN {lag(k)} IS NOT NULL THEN {v!r}::DOUBLE ELSE 0 END" for k, v in enumerate(x)) + ")"
    return f"""WITH RECURSIVE a AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6 AS tm, {smooth} AS smooth FROM scores WINDOW w AS ({_BY})),
    b AS (SELECT *, sum(CASE WHEN smooth > 60 THEN 1 ELSE 0 END) OVER ({_BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS lasting FROM a),
    c AS (SELECT *, lasting AND NOT coalesce(lag(lasting) OVER ({_BY}), false) AS edge FROM b),
    e AS (SELECT user_id, event_type, event_id, tm, row_number() OVER ({_BY}) AS n FROM c WHERE edge),
    r AS (SELECT user_id, event_type, event_id, n, tm AS last, true AS emits FROM e WHERE n = 1 UNION ALL
          SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN e.tm - r.last >= {cooldown} THEN e.tm ELSE r.last END, e.tm - r.last >= {cooldown} FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1),
    g AS (SELECT c.user_id || '/' || c.event_type AS track, c.event_id AS seq, round(c.smooth, 7) AS smooth, c.lasting, coalesce(r.emits, false) AS emits FROM c LEFT JOIN r ON r.event_id = c.event_id) {out}"""


@query("s01_tubelets", f"""WITH RECURSIVE h AS (SELECT user_id, event_type, event_id, score, row_number() OVER ({_BY}) AS n, event_id - lag(event_id) OVER ({_BY}) > 601 AS anew FROM scores),
    r AS (SELECT user_id, event_type, event_id, n, [score] AS held, CAST(NULL AS BIGINT) AS last, false AS due FROM h WHERE n = 1 UNION ALL
          SELECT user_id, event_type, event_id, n, held, CASE WHEN due THEN event_id ELSE last END, due FROM (SELECT *, len(held) = 6 AND (last IS NULL OR event_id - last >= 400) AS due FROM (
              SELECT h.user_id, h.event_type, h.event_id, h.n, CASE WHEN h.anew THEN [h.score] WHEN len(r.held) = 6 THEN list_append(r.held[2:6], h.score) ELSE list_append(r.held, h.score) END AS held, CASE WHEN h.anew THEN NULL ELSE r.last END AS last
              FROM r JOIN h ON h.user_id = r.user_id AND h.event_type = r.event_type AND h.n = r.n + 1)))
    SELECT user_id || '/' || event_type AS track, event_id AS seq, held AS scores FROM r WHERE due""")
def _(spark, d):
    return gates.tubelets(samples(spark, d), TUBELETS)


@query("s02_gate_state", gate_sql(5.0, "SELECT * FROM g"))
def _(spark, d):
    out = gates.batch(samples(spark, d), gates.Gate(threshold=60.0, sigma=1.0))
    return out.withColumn("smooth", F.round("smooth", 7))


@query("s03_emitted_events", gate_sql(86400.0, "SELECT track, seq FROM g WHERE emits"))
def _(spark, d):
    return gates.batch(samples(spark, d), GATE).where("emits").select("track", "seq")


@query("s05_downsampled", "SELECT user_id || '/' || event_type AS track, event_id AS seq FROM scores WHERE event_id % 2 = 0")
def _(spark, d):
    return gates.route(samples(spark, d), 2).select("track", "seq")


@query("s06_ttl_dedup", """WITH RECURSIVE h AS (SELECT label, vec_id, vec_id / 10 AS tm, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM vectors),
    r AS (SELECT label, vec_id, n, [{'tm': tm, 'v': v}] AS held, true AS fresh FROM h WHERE n = 1 UNION ALL
          SELECT label, vec_id, n, CASE WHEN fresh THEN list_append(near, {'tm': tm, 'v': v}) ELSE near END, fresh FROM (SELECT *, len(list_filter(near, lambda u: list_cosine_similarity(u.v, v) >= 0.3)) = 0 AS fresh FROM (
              SELECT h.label, h.vec_id, h.n, h.tm, h.v, list_filter(r.held, lambda u: h.tm - u.tm <= 30) AS near FROM r JOIN h ON h.label = r.label AND h.n = r.n + 1)))
    SELECT label, vec_id FROM r WHERE fresh""")
def _(spark, d):
    v = V.vectors(spark, d).select("label", (F.col("vec_id") / 10).alias("at"), "v", "vec_id")
    return gates.deduplicated(v, gates.Recent(ttl=30.0, least=0.3, most=1000), "label", "at", "v", "vec_id")


@query("s10_scheduled_detection", "SELECT event_id FROM events WHERE value > 95 OR (user_id % 50 = 0 AND value > 20) OR event_id % 5 = 0")
def _(spark, d):
    e = V.table(spark, d, "events")
    due = gates.scheduled(F.col("event_id"), F.col("value") > 95, (F.col("user_id") % 50 == 0) & (F.col("value") > 20), 5)
    return e.where(due).select("event_id")


@query("s14_frame_buffer", f"SELECT track, seq, frames FROM (SELECT user_id || '/' || event_type AS track, event_id AS seq, score, list(event_id) OVER ({_BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS frames FROM scores) WHERE score >= 90")
def _(spark, d):
    return gates.frame_buffers(samples(spark, d), 5, "score >= 90")


@query("s11_frequency_alerts", """WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, user_id % 25 AS camera_id FROM events),
    n AS (SELECT camera_id, start, count(*) AS n FROM w GROUP BY 1, 2) SELECT camera_id, start, n, rule_id FROM n JOIN (VALUES (1, 3, 2), (2, NULL, 4)) AS r(rule_id, cam, threshold) ON (r.cam IS NULL OR r.cam = n.camera_id) AND n.n > r.threshold""")
def _(spark, d):
    e = V.table(spark, d, "events").select((F.col("user_id") % 25).alias("camera_id"), F.col("ts").cast("timestamp").alias("ts"))
    rules = spark.sql("SELECT * FROM VALUES (1, 3L, 2L), (2, NULL, 4L) AS r(rule_id, camera_id, threshold)")
    a = alerts.frequency_alerts(e, rules, length="2 hours", slide="1 hour")
    return a.select("camera_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "rule_id")


#: Rules by camera from the nations, and, later, for all cameras from the regions; the second of them changes the first nations' rules.
_RULES = """SELECT CAST(n_nationkey AS BIGINT) AS camera_id, 1704067200.0 + n_nationkey * 40000 AS tm, CAST(n_regionkey AS BIGINT) AS rule_id, CAST(CASE WHEN n_nationkey % 6 <> 5 THEN 1 + n_nationkey % 3 END AS BIGINT) AS threshold, CAST(21600 + 3600 * (n_nationkey % 4) AS DOUBLE) AS seconds FROM nation
    UNION ALL SELECT NULL, 1704067200.0 + 900000 + r_regionkey * 50000, CAST(r_regionkey AS BIGINT), CAST(2 + r_regionkey % 2 AS BIGINT), CAST(28800 AS DOUBLE) FROM region"""


@query("s11b_alerts_that_remember", f"""WITH RECURSIVE given AS ({_RULES}),
    rules AS (SELECT camera_id, tm, rule_id, threshold, seconds FROM given WHERE camera_id IS NOT NULL UNION ALL SELECT c.id, tm, rule_id, threshold, seconds FROM given, cameras c WHERE camera_id IS NULL),
    versions AS (SELECT *, coalesce(lead(tm) OVER (PARTITION BY camera_id, rule_id ORDER BY tm), 1e18) AS till FROM rules),
    e AS (SELECT user_id % 25 AS camera_id, epoch_us(ts) / 1e6 AS tm, event_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS k FROM events),
    c AS (SELECT e.camera_id, v.rule_id, e.tm, e.k, e.k - (SELECT count(*) FROM e x WHERE x.camera_id = e.camera_id AND e.tm - x.tm >= v.seconds) AS n, v.threshold
          FROM e JOIN versions v ON v.camera_id = e.camera_id AND e.tm >= v.tm AND e.tm < v.till),
    h AS (SELECT *, row_number() OVER (PARTITION BY camera_id, rule_id ORDER BY k) AS i FROM c WHERE n > threshold),
    r AS (SELECT camera_id, rule_id, i, tm AS last, tm, n, threshold, true AS sends FROM h WHERE i = 1 UNION ALL
          SELECT h.camera_id, h.rule_id, h.i, CASE WHEN h.tm - r.last >= 43200 THEN h.tm ELSE r.last END, h.tm, h.n, h.threshold, h.tm - r.last >= 43200 FROM r JOIN h ON h.camera_id = r.camera_id AND h.rule_id = r.rule_id AND h.i = r.i + 1)
    SELECT camera_id, rule_id, round(tm, 3) AS tm, CAST(n AS BIGINT) AS n, threshold FROM r WHERE sends""")
def _(spark, d):
    nation, region = V.table(spark, d, "nation"), V.table(spark, d, "region")
    key = F.col("n_nationkey")
    own = nation.select(key.cast("long").alias("camera_id"), (1704067200.0 + key * 40000).alias("at"), F.col("n_regionkey").cast("long").alias("rule_id"), F.when(key % 6 != 5, 1 + key % 3).cast("long").alias("threshold"), (21600 + 3600 * (key % 4)).cast("double").alias("seconds"))
    key = F.col("r_regionkey")
    every = region.select(F.lit(None).cast("long").alias("camera_id"), (1704067200.0 + 900000 + key * 50000).alias("at"), key.cast("long").alias("rule_id"), (2 + key % 2).cast("long").alias("threshold"), F.lit(28800.0).alias("seconds"))
    events = V.table(spark, d, "events").select((F.col("user_id") % 25).alias("camera_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    rows = processors.changes_and_events(events, own.unionByName(every), V.cameras(spark, d).select(F.col("id").alias("camera_id")))
    out = processors.alerts(rows, processors.Frequency(quiet=43200.0, longest=86400.0))
    return out.select("camera_id", "rule_id", F.round("at", 3).alias("tm"), "n", "threshold")


@query("s13_heartbeat", "SELECT user_id || '/' || event_type AS track, count(*) AS samples, round((count(*) - 1) / nullif(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 0), 12) AS fps FROM scores GROUP BY 1")
def _(spark, d):
    return gates.heartbeat(samples(spark, d), "track").select("track", "samples", F.round("fps", 12).alias("fps"))
