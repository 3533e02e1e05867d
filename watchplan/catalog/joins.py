"""Queries of joins (J-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.functions import text as T
from watchplan.operators import decisions as D
from watchplan.operators import joins as O
from watchplan.plans import rules as R
from watchplan.plans import views as V


def _star(spark, d):
    p = V.people(spark, d).withColumnRenamed("id", "pid")
    c = V.cameras(spark, d).select(F.col("id").alias("cid"), F.col("name").alias("camera"))
    return O.star(V.logs(spark, d), [(p, "detected_id", "pid"), (c, "camera_id", "cid")])


_STAR = "FROM logs l LEFT JOIN people p ON l.detected_id = p.id LEFT JOIN cameras c ON l.camera_id = c.id"


@query("j01_star_join", f"SELECT l.id, coalesce(p.employee_name, p.visitor_name, p.name, 'Unknown') AS person, coalesce(c.name, 'Camera ' || l.camera_id) AS camera {_STAR} WHERE p.id IS NOT NULL")
def _(spark, d):
    rows = _star(spark, d).where("pid is not null")
    return rows.select("id", F.coalesce("employee_name", "visitor_name", "name", F.lit("Unknown")).alias("person"), F.coalesce("camera", F.concat(F.lit("Camera "), F.col("camera_id").cast("string"))).alias("camera"))


@query("j02_unknown_left_chain", "SELECT l.id, c.name AS camera FROM logs l LEFT JOIN cameras c ON l.camera_id = c.id WHERE l.detected_id IS NULL")
def _(spark, d):
    return _star(spark, d).where("detected_id is null").select("id", "camera")


@query("j03_left_fan_out", "SELECT o.o_orderkey AS id, count(l.l_orderkey) AS matches FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def _(spark, d):
    o, line = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    return o.join(line, o["o_orderkey"] == line["l_orderkey"], "left").groupBy(F.col("o_orderkey").alias("id")).agg(F.count("l_orderkey").alias("matches"))


@query("j04_bridge_join", "SELECT a.id, r.seq, r.part, r.supp, r.gate, c.name AS camera FROM cases a JOIN results r ON r.case_id = a.id LEFT JOIN cameras c ON a.camera_id = c.id WHERE a.severity = 'critical'")
def _(spark, d):
    a, r, c = V.cases(spark, d).where("severity = 'critical'").select("id", "camera_id"), V.results(spark, d), V.cameras(spark, d).select(F.col("id").alias("cid"), F.col("name").alias("camera"))
    return a.join(r, a["id"] == r["case_id"]).join(c, F.col("camera_id") == F.col("cid"), "left").select("id", "seq", "part", "supp", "gate", "camera")


@query("j05_evidence_media", "SELECT l.l_orderkey AS case_id, l.l_linenumber AS seq, l.l_suppkey AS supp, p.p_name AS media, p.p_size AS bytes FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 25")
def _(spark, d):
    line, part = V.table(spark, d, "lineitem"), V.table(spark, d, "part").where("p_size > 25")
    return line.join(part, line["l_partkey"] == part["p_partkey"], "left").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("supp"), F.col("p_name").alias("media"), F.col("p_size").alias("bytes"))


@query("j06_any_of_three_ids", "WITH ev AS (SELECT id, id % 97 AS s, id % 89 AS p, CASE WHEN id % 5 <> 0 THEN id % 97 + 1 END AS e FROM cases) SELECT ev.id, g.event_id AS score_id, g.score FROM ev JOIN scores g ON g.event_id IN (ev.s, ev.p, ev.e)")
def _(spark, d):
    ev = V.cases(spark, d).select("id", (F.col("id") % 97).alias("s"), (F.col("id") % 89).alias("p"), F.when(F.col("id") % 5 != 0, F.col("id") % 97 + 1).alias("e"))
    return O.any_id(ev, ["s", "p", "e"], V.scores(spark, d).select(F.col("event_id").alias("score_id"), "score"), "score_id").select("id", "score_id", "score")


@query("j07_latest_result_per_case", "SELECT a.id, r.seq, r.ts, r.price FROM cases a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, seq DESC, price DESC) AS n FROM results) r ON r.case_id = a.id AND r.n = 1")
def _(spark, d):
    a, r = V.cases(spark, d).select("id"), O.latest_by_max(V.results(spark, d), ["case_id"], ["ts", "seq", "price"], [])
    return a.join(r, a["id"] == r["case_id"], "left").select("id", "seq", "ts", "price")


@query("j08_primary_link", "SELECT case_id, gate, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY (gate = 'pose') DESC, ts DESC, price DESC) AS n FROM results) WHERE n = 1")
def _(spark, d):
    r = V.results(spark, d)
    return O.latest(r, ["case_id"], [(F.col("gate") == "pose").desc(), F.col("ts").desc(), F.col("price").desc()]).select("case_id", "gate", "ts", "price")


@query("j09_exists", "SELECT id FROM cases a WHERE EXISTS (SELECT 1 FROM results r WHERE r.case_id = a.id AND r.decision = 'YES' AND upper(r.severity) = 'HIGH')")
def _(spark, d):
    r = V.results(spark, d).where("decision = 'YES' and upper(severity) = 'HIGH'").select(F.col("case_id").alias("id"))
    return O.exists(V.cases(spark, d), r, ["id"]).select("id")


@query("j10_interval_overlap", """WITH g AS (SELECT id, track_id, CASE WHEN id % 2 = 0 THEN 'pose' ELSE 'deep' END AS gate, start_ts, start_ts + INTERVAL 30 DAY AS peak FROM cases)
    SELECT a.id, max(b.id) AS other, count(*) AS overlaps FROM g a JOIN g b ON a.track_id = b.track_id AND a.gate <> b.gate AND b.start_ts < a.peak AND b.peak > a.start_ts GROUP BY a.id""")
def _(spark, d):
    g = V.cases(spark, d).select("id", "track_id", F.when(F.col("id") % 2 == 0, "pose").otherwise("deep").alias("gate"), "start_ts", (F.col("start_ts") + F.expr("INTERVAL 30 DAYS")).alias("peak"))
    both = O.interval_overlap(g, g, ["track_id"], ("start_ts", "peak"), ("start_ts", "peak"), "30 days").where("gate <> r_gate")
    return both.groupBy("id").agg(F.max("r_id").alias("other"), F.count(F.lit(1)).alias("overlaps"))


@query("j12_orphans", "SELECT l_orderkey AS case_id, l_linenumber AS seq, l_suppkey AS supp FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def _(spark, d):
    o = V.table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return O.orphans(V.table(spark, d, "lineitem"), o, ["l_orderkey"]).select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("supp"))


@query("j13_lookup_by_id", "SELECT r.case_id, r.seq, r.supp, r.part, a.status FROM results r LEFT JOIN cases a ON a.id = r.case_id AND a.status <> 'closed'")
def _(spark, d):
    a = V.cases(spark, d).where("status <> 'closed'").select("id", "status")
    r = V.results(spark, d)
    return r.join(a, r["case_id"] == a["id"], "left").select("case_id", "seq", "supp", "part", "status")


@query("j14_rule_conflicts", """SELECT a.id AS a, b.id AS b FROM rules a JOIN rules b ON a.id < b.id
    AND (a.rule_type <> b.rule_type OR a.rule_type = 'other' OR b.rule_type = 'other') AND (a.event = b.event OR a.event = 'other' OR b.event = 'other')
    AND (lower(trim(a.place)) = lower(trim(b.place)) OR lower(trim(a.place)) = 'all' OR lower(trim(b.place)) = 'all')""")
def _(spark, d):
    return O.conflicting_rules(V.rules(spark, d))


@query("j15_rule_duplicates", "WITH n AS (SELECT id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, lower(rule_type) AS y, event, lower(place) AS p FROM rules) SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id AND a.t = b.t AND a.y = b.y AND a.event = b.event AND a.p = b.p")
def _(spark, d):
    return O.duplicate_rules(V.rules(spark, d))


#: What is seen of a result, by the part number: seen events, and evidence.
_EVENTS = ["running", "fighting", "suspicious_motion", "normal_activity", "unsafe_equipment_interaction", "fall_or_collapse", "loitering"]
_EVIDENCE = ["two men fight beside the gate", "someone delivers a box", "a man runs through the hall", ""]


@query("j16_rule_matching", f"""WITH rules AS ({R.SQL}), names AS (SELECT * FROM (VALUES ('fighting', 'fight_detection'), ('fall_or_collapse', 'fall_detected'), ('suspicious_motion', 'intrusion'), ('suspicious_motion', 'loitering'), ('suspicious_motion', 'after_hours'), ('unsafe_equipment_interaction', 'other'), ('unsafe_equipment_interaction', 'equipment')) AS m(seen, said)),
    x AS (SELECT case_id, seq, part, supp, price, decision, CASE WHEN supp % 29 = 0 THEN 'UNUSABLE' ELSE 'FAIR' END AS quality, CASE supp % 4 WHEN 0 THEN 'Main Lobby' WHEN 1 THEN 'Garage' WHEN 2 THEN 'Roof' END AS site, {_EVENTS!r}[part % 7 + 1] AS event, {_EVIDENCE!r}[part % 4 + 1] AS evidence FROM results),
    w AS (SELECT evidence, list_filter(regexp_extract_all(lower(evidence), '[a-z_]{{3,}}'), lambda v: NOT list_contains({T.STOPWORDS!r}, v)) AS words FROM (SELECT DISTINCT evidence FROM x)),
    r AS (SELECT id, lower(place) AS place, event, rule_type = 'suppress' AS mutes, list_filter(regexp_extract_all(lower(text || ' ' || event), '[a-z_]{{3,}}'), lambda v: NOT list_contains({T.STOPWORDS!r}, v)) AS words FROM rules),
    f AS (SELECT k.*, r.id AS rule, r.mutes FROM (SELECT DISTINCT site, event, x.evidence, w.words FROM x JOIN w ON w.evidence = x.evidence) k JOIN r ON (r.place = 'all' OR k.site IS NULL OR contains(lower(k.site), r.place) OR contains(r.place, lower(k.site)))
        AND ((r.event = 'other' AND k.event <> 'normal_activity') OR (r.event <> 'other' AND (r.event = k.event OR EXISTS (SELECT 1 FROM names m WHERE m.seen = k.event AND m.said = r.event))) OR len(list_intersect(k.words, r.words)) > 0))
    SELECT x.case_id, x.seq, x.part, x.supp, x.price, f.rule, CASE WHEN f.mutes THEN 'suppress' ELSE 'trigger' END AS kind FROM x JOIN f ON f.site IS NOT DISTINCT FROM x.site AND f.event = x.event AND f.evidence = x.evidence AND x.quality <> 'UNUSABLE' AND (f.mutes OR (x.evidence <> '' AND x.decision IN ('YES', 'UNCERTAIN')))""")
def _(spark, d):
    four, pick = F.col("supp") % 4, lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    rows = V.results(spark, d).select("case_id", "seq", "part", "supp", "price", "decision", F.when(F.col("supp") % 29 == 0, "UNUSABLE").otherwise("FAIR").alias("quality"), F.when(four == 0, "Main Lobby").when(four == 1, "Garage").when(four == 2, "Roof").alias("site"), pick(_EVENTS, F.col("part") % 7).alias("event"), F.nullif(pick(_EVIDENCE, F.col("part") % 4), F.lit("")).alias("said"))
    # what is seen repeats: rules are matched with the distinct sights, and results get theirs by an equi-join
    sight = ["site", "event", "decision", "quality", "said"]
    seen = rows.select(*sight).distinct().withColumn("evidence", F.array_compact(F.array("said")))
    rules = R.rules(spark).select(F.col("id").alias("rule"), "rule_type", "event", "place", "text", F.lit(True).alias("active"))
    found = D.matched_rules(seen, rules).select(*(F.col(c).alias(f"s_{c}") for c in sight), "rule", F.col("rule_type").alias("kind"))
    on = [rows[c].eqNullSafe(F.col(f"s_{c}")) for c in sight]
    return rows.join(O.small(found), on).select("case_id", "seq", "part", "supp", "price", "rule", "kind")


@query("j17_rule_conditions", f"""WITH rules AS ({R.SQL}), x AS (SELECT case_id, seq, part, supp, price, CASE WHEN gate = 'homography_macro' THEN 'homography' ELSE gate END AS gate, CASE WHEN threshold > 0 THEN score / threshold END AS ratio, part % 2 = 0 AS evidence FROM results)
    SELECT x.case_id, x.seq, x.part, x.supp, x.price, r.id AS rule FROM x JOIN (SELECT *, unnest(string_split(gates, ',')) AS own FROM rules) r ON r.own = x.gate AND (r.min_ratio IS NULL OR x.ratio >= r.min_ratio) AND (r.max_ratio IS NULL OR x.ratio <= r.max_ratio) AND (NOT r.needs_evidence OR x.evidence)""")
def _(spark, d):
    gate = F.when(F.col("gate") == "homography_macro", "homography").otherwise(F.col("gate"))
    x = V.results(spark, d).select("case_id", "seq", "part", "supp", "price", gate.alias("gate"), F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold")).alias("ratio"), (F.col("part") % 2 == 0).alias("evidence"))
    r = R.rules(spark).select(F.col("id").alias("rule"), F.explode(F.split("gates", ",")).alias("gate"), "min_ratio", "max_ratio", "needs_evidence")
    fits = (F.col("min_ratio").isNull() | (F.col("ratio") >= F.col("min_ratio"))) & (F.col("max_ratio").isNull() | (F.col("ratio") <= F.col("max_ratio"))) & (~F.col("needs_evidence") | F.col("evidence"))
    return x.join(O.small(r), "gate").where(fits).select("case_id", "seq", "part", "supp", "price", "rule")


@query("j18_first_matching_key", """WITH look AS (SELECT c_name AS key, min(c_mktsegment) AS seg FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1),
    k AS (SELECT c_custkey AS id, c_name AS k1, 'Customer#' || lpad(CAST(c_custkey // 2 * 4 AS VARCHAR), 9, '0') AS k2 FROM customer)
    SELECT k.id, coalesce(a.seg, b.seg, 'none') AS seg FROM k LEFT JOIN look a ON a.key = k.k1 LEFT JOIN look b ON b.key = k.k2""")
def _(spark, d):
    c = V.table(spark, d, "customer")
    look = c.where("c_custkey % 4 = 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("seg"))
    k = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("k1"), F.concat(F.lit("Customer#"), F.lpad((F.floor(F.col("c_custkey") / 2) * 4).cast("string"), 9, "0")).alias("k2"))
    return O.first_key(k, ["k1", "k2"], look, "key", "seg").select("id", F.coalesce("seg", F.lit("none")).alias("seg"))


@query("j19_close_pairs", """WITH f AS (SELECT event_id, date_trunc('hour', ts) AS frame, user_id % 10 AS x, value FROM events)
    SELECT a.event_id AS a, b.event_id AS b FROM f a JOIN f b ON a.frame = b.frame AND a.event_id < b.event_id AND abs(a.x - b.x) <= 1 AND abs(a.value - b.value) < 5""")
def _(spark, d):
    f = V.table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("frame"), (F.col("user_id") % 10).alias("x"), "value")
    return O.close_pairs(f, "event_id", ["frame"], {"x": (1, True), "value": (5, False)}).select("a", "b")


@query("j21_resume_unprocessed", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def _(spark, d):
    done = V.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"))
    return O.orphans(V.table(spark, d, "events"), done, ["event_id"]).select("event_id")


@query("j22_mapped_default", "SELECT l.id, coalesce(CASE WHEN l.k % 4 = 0 THEN 'cam-' || l.k END, c.name, 'camera_001') AS camera FROM logs l LEFT JOIN cameras c ON c.id = l.camera_id")
def _(spark, d):
    rec = F.when(F.col("k") % 4 == 0, F.concat(F.lit("cam-"), F.col("k").cast("string")))
    return _star(spark, d).select("id", F.coalesce(rec, "camera", F.lit("camera_001")).alias("camera"))
