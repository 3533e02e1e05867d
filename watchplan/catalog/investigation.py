"""The named investigation queries with parameters, and the dashboard's parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.operators import aggregates as A
from watchplan.plans import investigation as I
from watchplan.plans import views as V

_SEEN = "SELECT l.id, l.ts, coalesce(p.employee_name, p.visitor_name, p.name) AS person, coalesce(c.name, 'Camera ' || l.camera_id) AS camera, p.id AS person_id, l.detected_id, l.camera_id, l.quality, l.processing_ms, concat_ws('~', p.employee_name, p.visitor_name, p.name) AS said FROM logs l LEFT JOIN people p ON l.detected_id = p.id LEFT JOIN cameras c ON l.camera_id = c.id"
_SIM = "SELECT g.vec_id, g.label, list_cosine_similarity(q.v, g.v) AS s FROM vectors g, (SELECT v FROM vectors WHERE vec_id = 12) q WHERE g.vec_id <> 12"
_CAM = "coalesce(c.name, 'Camera ' || x.camera_id)"

#: name -> parameters, SQL
_CASES: dict[str, tuple[dict, str | None]] = {
    "person_last_seen": ({"name": "00012"}, f"SELECT id, ts, person, camera FROM ({_SEEN}) WHERE said ILIKE '%00012%' ORDER BY ts DESC, id DESC LIMIT 1"),
    "person_first_seen": ({"name": "00012"}, f"SELECT id, ts, person, camera FROM ({_SEEN}) WHERE said ILIKE '%00012%' ORDER BY ts, id LIMIT 1"),
    "person_timeline": ({"name": "000012", "days_back": 20}, f"SELECT id, ts, person, camera FROM ({_SEEN}) WHERE said ILIKE '%000012%' AND ts >= TIMESTAMP '2024-01-11' ORDER BY ts DESC, id DESC LIMIT 200"),
    "people_seen_on_date": ({"date": "2024-01-15"}, """SELECT p.id, coalesce(p.employee_name, p.visitor_name, p.name) AS person, CASE WHEN p.employee_name IS NOT NULL THEN 'employee' WHEN p.visitor_name IS NOT NULL THEN 'visitor' ELSE 'enrolled' END AS kind,
        count(*) AS seen, min(l.ts) AS first_seen, max(l.ts) AS last_seen, string_agg(DISTINCT coalesce(c.name, 'Camera ' || l.camera_id), ', ' ORDER BY coalesce(c.name, 'Camera ' || l.camera_id)) AS cameras
        FROM logs l JOIN people p ON l.detected_id = p.id LEFT JOIN cameras c ON l.camera_id = c.id WHERE CAST(l.ts AS DATE) = DATE '2024-01-15' GROUP BY ALL ORDER BY seen DESC, p.id LIMIT 100"""),
    "known_people": ({"limit": 15}, " UNION ALL ".join(f"(SELECT '{k}' AS kind, id, {c} AS name FROM people WHERE {c} IS NOT NULL ORDER BY {c}, id LIMIT 15)" for k, c in (("employee", "employee_name"), ("visitor", "visitor_name"), ("enrolled", "name")))),
    "count_unknown_detections": ({"days_back": 10, "hour": 9}, "SELECT count(*) AS unknown FROM logs WHERE detected_id IS NULL AND ts >= TIMESTAMP '2024-01-21' AND hour(ts) = 9"),
    "count_known_detections": ({"date": "2024-01-12"}, f"SELECT count(*) AS known FROM ({_SEEN}) WHERE said <> '' AND CAST(ts AS DATE) = DATE '2024-01-12'"),
    "count_all_detections": ({"days_back": 3}, "SELECT count(*) AS every FROM logs WHERE ts >= TIMESTAMP '2024-01-28'"),
    "unknown_face_events": ({"camera_id": 4, "limit": 30}, f"SELECT id, ts, camera, quality FROM ({_SEEN}) WHERE detected_id IS NULL AND camera_id = 4 ORDER BY ts DESC, id DESC LIMIT 30"),
    "unknown_face_details": ({"event_id": 0}, f"SELECT id, ts, camera, quality, processing_ms FROM ({_SEEN}) WHERE detected_id IS NULL AND id = 0"),
    "similar_unknown_faces": ({"event_id": 12, "threshold": 0.2}, f"SELECT vec_id, round(s, 6) AS similarity FROM ({_SIM}) WHERE s >= 0.2 ORDER BY round(s, 12) DESC, vec_id LIMIT 10"),
    "possible_identity_match": ({"event_id": 12, "threshold": 0.2}, f"SELECT x.vec_id, x.label, coalesce(p.employee_name, p.visitor_name, p.name) AS person, round(s, 6) AS similarity FROM (SELECT * FROM ({_SIM}) WHERE s >= 0.2 ORDER BY round(s, 12) DESC, vec_id LIMIT 5) x LEFT JOIN people p ON p.id = x.label"),
    "investigate_unknown_face": ({"event_id": 0, "threshold": 0.2}, """WITH s AS (SELECT g.vec_id, g.label, list_cosine_similarity(q.v, g.v) AS s FROM vectors g, (SELECT v FROM vectors WHERE vec_id = 0) q WHERE g.vec_id <> 0)
        SELECT * FROM ((SELECT 'similar' AS kind, vec_id AS id, round(s, 6) AS similarity FROM s WHERE s >= 0.2 ORDER BY round(s, 12) DESC, vec_id LIMIT 10) UNION ALL (SELECT 'identity', label, round(s, 6) FROM s WHERE s >= 0.2 ORDER BY round(s, 12) DESC, vec_id LIMIT 5)
        UNION ALL SELECT 'event', id, NULL FROM logs WHERE id = 0 AND detected_id IS NULL)"""),
    "pending_unknowns": ({"limit": 25, "offset": 5}, "SELECT id, ts, camera_id, quality, event_type FROM logs WHERE detected_id IS NULL AND authorized IS NULL ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 5"),
    "recent_logs": ({"limit": 30, "offset": 10}, "SELECT l.id, l.ts, l.detected_id, p.name AS identity, l.camera_id, l.authorized, l.similarity, l.margin FROM (SELECT * FROM logs ORDER BY ts DESC, id DESC LIMIT 30 OFFSET 10) l LEFT JOIN people p ON p.id = l.detected_id"),
    "log_by_id": ({"log_id": 3}, "SELECT l.id, l.ts, l.detected_id, p.name AS identity, l.camera_id, l.quality FROM logs l LEFT JOIN people p ON p.id = l.detected_id WHERE l.id = 3"),
    "max_similarity_for_identity": ({"event_id": 7, "label": 3}, "SELECT g.label, round(max(list_cosine_similarity(q.v, g.v)), 6) AS similarity FROM vectors g, (SELECT v FROM vectors WHERE vec_id = 7) q WHERE g.vec_id <> 7 AND g.label = 3 GROUP BY 1"),
    "joined_jobs": ({"status": "succeeded", "decision": "YES", "limit": 40}, "SELECT r.case_id, r.seq, 'succeeded' AS status, r.decision, a.status AS case_status, a.camera_id, r.ts, r.price FROM (SELECT * FROM results WHERE decision = 'YES' ORDER BY ts DESC, price DESC LIMIT 40) r JOIN cases a ON a.id = r.case_id"),
    "vad_cases": ({"status": "open", "severity": "HIGH"}, "SELECT x.id, x.status, x.severity, x.start_ts, c.name AS camera FROM (SELECT * FROM cases WHERE status = 'open' AND severity = 'high' ORDER BY start_ts DESC, id DESC LIMIT 20) x LEFT JOIN cameras c ON c.id = x.camera_id"),
    "vad_case_details": ({"case_id": 7}, "SELECT a.id, a.status, a.severity, r.decision, r.gate, r.ts, r.price FROM (SELECT * FROM cases WHERE id = 7) a LEFT JOIN (SELECT * FROM results WHERE case_id = 7 ORDER BY ts DESC, seq DESC, price DESC LIMIT 1) r ON r.case_id = a.id"),
    "vad_gate_events": ({"gate": "homography", "limit": 20}, "SELECT case_id, seq, gate, score, ts, price FROM results WHERE contains(gate, 'homography') ORDER BY ts DESC, price DESC LIMIT 20"),
    "vad_reasoning_jobs": ({"status": "failed", "limit": 25}, "SELECT case_id, seq, 'failed' AS status, ts, price FROM results WHERE decision IS NULL ORDER BY ts DESC, price DESC LIMIT 25"),
    "vad_reasoning_results": ({"decision": "YES", "severity": "high", "limit": 25}, "SELECT case_id, seq, decision, upper(severity) AS severity, price FROM results WHERE decision = 'YES' AND upper(severity) = 'HIGH' ORDER BY ts DESC, price DESC LIMIT 25"),
    "vad_case_reviews": ({"limit": 25}, "SELECT id, severity, start_ts FROM cases WHERE status = 'reviewing' ORDER BY start_ts DESC, id DESC LIMIT 25"),
    "vad_case_gate_events": ({"case_id": 7}, "SELECT a.id, r.seq, r.gate, r.ts, c.name AS camera, r.price FROM cases a JOIN results r ON r.case_id = a.id LEFT JOIN cameras c ON c.id = a.camera_id WHERE a.id = 7"),
    "vad_case_evidence": ({"case_id": 7}, "SELECT l_orderkey AS case_id, l_linenumber AS seq, p_name AS media, l_extendedprice AS price FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7"),
    "vad_gate_scores": ({"case_id": 207}, "SELECT a.id, g.event_id AS score_id, g.score FROM cases a JOIN scores g ON g.event_id IN (a.id % 97, a.id % 89, a.id % 97 + 1) WHERE a.id = 207"),
    "vad_streams": ({}, "SELECT camera_id, count(*) AS events, max(ts) AS last_ts FROM logs GROUP BY 1 ORDER BY 1 LIMIT 50"),
    "vad_stream_sessions": ({"camera_id": 2}, "SELECT camera_id, CAST(ts AS DATE) AS day, min(ts) AS started, max(ts) AS ended, count(*) AS frames FROM logs WHERE camera_id = 2 GROUP BY 1, 2 ORDER BY started DESC LIMIT 50"),
    "cameras": ({}, "SELECT id, name, site FROM cameras ORDER BY id LIMIT 100"),
    "edge_devices": ({}, "SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AS online FROM supplier ORDER BY 1 LIMIT 100"),
    "anomaly_rules": ({"place": "brand#1"}, "SELECT id, rule_type, event, place, text FROM rules WHERE contains(lower(place), 'brand#1') ORDER BY id LIMIT 50"),
    "reasoning_rules": ({"gate": "pose"}, "SELECT id, gates, min_ratio, max_ratio, needs_evidence FROM rules WHERE list_contains(string_split(gates, ','), 'pose') ORDER BY id LIMIT 50"),
    "rule_conflicts": ({}, """SELECT a.id AS a, b.id AS b FROM rules a JOIN rules b ON a.id < b.id AND (a.rule_type <> b.rule_type OR a.rule_type = 'other' OR b.rule_type = 'other') AND (a.event = b.event OR a.event = 'other' OR b.event = 'other')
        AND (lower(trim(a.place)) = lower(trim(b.place)) OR lower(trim(a.place)) = 'all' OR lower(trim(b.place)) = 'all') ORDER BY 1, 2 LIMIT 50"""),
    "schedules": ({}, "SELECT detected_id, min(hour(ts))::INT AS from_hour, max(hour(ts))::INT AS to_hour FROM logs WHERE detected_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 50"),
    "audit_logs": ({"action": "signup", "limit": 40}, "SELECT id, ts, upper(event_type) AS action FROM logs WHERE event_type = 'signup' ORDER BY ts DESC, id DESC LIMIT 40"),
    "table_counts": ({}, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())),
    "daily_summary": ({"date": "2024-01-15"}, "SELECT * FROM (SELECT count(*) AS detections, count(*) FILTER (WHERE detected_id IS NULL) AS unknown, count(DISTINCT detected_id) AS people, round(avg(quality), 3) AS avg_quality FROM logs WHERE CAST(ts AS DATE) = DATE '2024-01-15'), (SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'open') AS open_cases FROM cases)"),
    "camera_activity": ({}, f"SELECT x.camera_id, {_CAM} AS camera, x.n, x.unknown FROM (SELECT camera_id, count(*) AS n, count(*) FILTER (WHERE detected_id IS NULL) AS unknown FROM logs WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1) x LEFT JOIN cameras c ON c.id = x.camera_id ORDER BY x.n DESC, x.camera_id LIMIT 20"),
    "identities": ({"limit": 40, "offset": 3}, "SELECT p.id, p.name, count(v.vec_id) AS embeddings, count(v.vec_id) FILTER (WHERE v.vec_id % 3 = 1) AS authoritative FROM (SELECT * FROM people ORDER BY id DESC LIMIT 40 OFFSET 3) p LEFT JOIN vectors v ON v.label = p.id % 12 GROUP BY 1, 2"),
    "active_model": ({"gate": "deep"}, "SELECT id, gate, version, activated FROM (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'pose' WHEN 1 THEN 'deep' ELSE 'homography_macro' END AS gate, s_name AS version, s_acctbal > 0 AS active, CASE WHEN s_suppkey % 4 > 0 THEN CAST(floor(s_acctbal / 500) AS BIGINT) END AS activated FROM supplier) WHERE active AND gate = 'deep' ORDER BY activated DESC NULLS LAST, id DESC LIMIT 1"),
    "primary_threshold": ({"model": 17}, "SELECT p_partkey AS id, p_partkey % 100 AS model, p_size AS percentile, p_retailprice AS value FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 100 = 17 ORDER BY 1 DESC LIMIT 1"),
    "event_evidence": ({"event_id": 7}, "SELECT r.seq, p.p_name AS object_key, p.p_type AS role, r.price FROM results r JOIN part p ON p.p_partkey = r.part WHERE r.case_id = 7"),
    "reasoning_jobs_of_event": ({"event_id": 7, "gate": "deep"}, "SELECT case_id, seq, gate, ts, price FROM results WHERE case_id = 7 AND gate = 'deep'"),
    "reasoning_results_of_event": ({"event_id": 7}, "SELECT case_id, seq, decision, upper(severity) AS severity, price FROM results WHERE case_id = 7 AND decision IS NOT NULL"),
}

for _name, (_params, _sql) in _CASES.items():
    query(f"inv_{_name}", _sql)(lambda spark, d, n=_name, p=_params: I.run(n, spark, d, **p))


# the dashboard: parts that its document puts together, all from one base

_GATES = ["pose", "deep", "homography"]
_BASE = "SELECT *, CASE WHEN contains(gate, 'homography') THEN 'homography' ELSE gate END AS g, CASE WHEN threshold > 0 THEN score / threshold END AS ratio, upper(coalesce(decision, 'FAILED')) AS final FROM results"


def base(spark, d):
    from watchplan.functions.text import gate_name
    from watchplan.operators.decisions import final_decision

    return V.results(spark, d).withColumn("g", gate_name(F.col("gate"))).withColumn("ratio", F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold"))).withColumn("final", final_decision(F.col("decision")))


def dashboard(spark, d) -> dict:
    """All parts of the dashboard; the base is read once and kept while they are made."""
    rows = base(spark, d).cache()
    try:
        return {name: [r.asDict() for r in part(spark, rows).collect()] for name, part in _PARTS.items()}
    finally:
        rows.unpersist()


def _gates(spark, rows):
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 6).alias("avg_ratio"), F.round(F.max("ratio"), 6).alias("max_ratio"))
    return A.domain(spark, "g", _GATES).join(F.broadcast(n), "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"), "avg_ratio", "max_ratio")


def _kpis(spark, rows):
    n = F.count(F.lit(1))
    return rows.agg(n.alias("events"), F.count_distinct("case_id").alias("cases"), A.percent(F.count_if(F.col("final") == "YES"), n).alias("yes_rate"), A.percent(F.count_if(F.col("final") == "FAILED"), n).alias("failed_rate"))


_PARTS = {
    "gates": _gates,
    "kpis": _kpis,
    "decisions": lambda spark, rows: A.zero_filled(rows.groupBy("final").agg(F.count(F.lit(1)).alias("n")), spark, "final", ["YES", "NO", "UNCERTAIN", "FAILED"]),
    "severities": lambda spark, rows: A.zero_filled(rows.groupBy(F.upper("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n")), spark, "severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW"]),
    "days": lambda spark, rows: A.histogram(rows, F.date_format("ts", "yyyy-MM-dd"), "day", "g", _GATES),
    "recent": lambda spark, rows: rows.orderBy(F.desc("ts"), F.desc("price")).limit(200).select("case_id", "g", "ts", "ratio", "price"),
}
_PART_SQL = {
    "gates": f"WITH b AS ({_BASE}), dom(g) AS (VALUES ('pose'), ('deep'), ('homography')) SELECT dom.g, count(b.g) AS n, round(avg(ratio), 6) AS avg_ratio, round(max(ratio), 6) AS max_ratio FROM dom LEFT JOIN b ON b.g = dom.g GROUP BY 1",
    "kpis": f"WITH b AS ({_BASE}) SELECT count(*) AS events, count(DISTINCT case_id) AS cases, CAST(round_even(count(*) FILTER (WHERE final = 'YES') * 100.0::DOUBLE / count(*), 0) AS BIGINT) AS yes_rate, CAST(round_even(count(*) FILTER (WHERE final = 'FAILED') * 100.0::DOUBLE / count(*), 0) AS BIGINT) AS failed_rate FROM b",
    "decisions": f"WITH b AS ({_BASE}), dom(final) AS (VALUES ('YES'), ('NO'), ('UNCERTAIN'), ('FAILED')) SELECT dom.final, count(b.final) AS n FROM dom LEFT JOIN b ON b.final = dom.final GROUP BY 1",
    "severities": f"WITH b AS ({_BASE}), dom(severity) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) SELECT dom.severity, count(b.final) AS n FROM dom LEFT JOIN b ON upper(b.severity) = dom.severity GROUP BY 1",
    "days": f"WITH b AS ({_BASE}) SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE g = 'pose') AS pose, count(*) FILTER (WHERE g = 'deep') AS deep, count(*) FILTER (WHERE g = 'homography') AS homography FROM b GROUP BY 1",
    "recent": f"WITH b AS ({_BASE}) SELECT case_id, g, ts, ratio, price FROM b ORDER BY ts DESC, price DESC LIMIT 200",
}
for _name, _part in _PARTS.items():
    query(f"dash_{_name}", _PART_SQL[_name])(lambda spark, d, part=_part: part(spark, base(spark, d)))
