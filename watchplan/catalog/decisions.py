"""Queries of decisions (R-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog import streams as S
from watchplan.catalog.registry import query
from watchplan.functions import text as T
from watchplan.operators import decisions as O
from watchplan.plans import views as V
from watchplan.streaming import gates

KEY = ["case_id", "seq", "price"]
_RATIO = "CASE WHEN threshold > 0 THEN score / threshold END"


def _ratio():
    return F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold"))


@query("r03_final_decision", "SELECT case_id, seq, price, upper(coalesce(CASE WHEN part % 5 = 0 THEN NULL ELSE decision END, CASE WHEN part % 7 = 0 THEN 'yes' END, 'FAILED')) AS decision FROM results")
def _(spark, d):
    a = F.when(F.col("part") % 5 == 0, F.lit("  ")).otherwise(F.col("decision"))
    return V.results(spark, d).select(*KEY, O.final_decision(a, F.when(F.col("part") % 7 == 0, "yes")).alias("decision"))


#: What the reasoning says, made up from the columns there are.
_SAID = f"""SELECT *, upper(coalesce(decision, 'UNCERTAIN')) AS d, upper(severity) AS s, CASE WHEN confidence = 0 THEN 0.3::DOUBLE ELSE least(confidence, 1.0::DOUBLE) END AS c, CASE seq % 3 WHEN 0 THEN 'save_for_dataset' WHEN 1 THEN 'alert_operator' ELSE 'review_only' END AS a,
    supp % 50 = 1 AS no_rules, part % 13 = 0 AS vlm_error, part % 17 = 0 AS llm_error, supp % 7 = 0 AS other_facts, part % 2 = 1 AS no_trigger, gate = 'homography_macro' AS not_concrete, supp % 5 = 0 AS unusable, seq % 4 = 0 AS suppressed, coalesce({_RATIO} < 1.15, false) AS weak FROM results"""


def _guard_sql() -> str:
    """One step for each guardrail, in order, as the decision goes from one to the next."""
    steps = [
        ("no_rules", "NO_ACTIVE_ANOMALY_RULES", 0.35, False), ("vlm_error", "VLM_PARSE_FALLBACK", 0.30, False), ("llm_error", "LLM_PARSE_FALLBACK", 0.30, False), ("other_facts", "LLM_USED_NON_VLM_FACTS", 0.40, False),
        ("no_trigger", "YES_WITHOUT_LLM_TRIGGER_RULE", 0.45, True), ("not_concrete", "YES_WITHOUT_CONCRETE_VISUAL_FACTS", 0.45, True), ("unusable", "YES_WITH_UNUSABLE_IMAGE_QUALITY", 0.40, True), ("suppressed", "YES_WITH_LLM_SUPPRESS_RULE", 0.50, True),
    ]
    out, last = [f"g0 AS (SELECT *, CAST([] AS VARCHAR[]) AS guards FROM ({_SAID}))"], "g0"
    for k, (flag, name, cap, yes) in enumerate(steps, 1):
        hit = f"({flag} AND d = 'YES')" if yes else flag
        out.append(f"g{k} AS (SELECT * REPLACE (CASE WHEN {hit} THEN 'UNCERTAIN' ELSE d END AS d, CASE WHEN {hit} THEN 'LOW' ELSE s END AS s, CASE WHEN {hit} THEN 'review_only' ELSE a END AS a, CASE WHEN {hit} THEN least(c, {cap}::DOUBLE) ELSE c END AS c, CASE WHEN {hit} THEN list_append(guards, '{name}') ELSE guards END AS guards) FROM {last})")
        last = f"g{k}"
    out.append(f"w AS (SELECT * REPLACE (CASE WHEN weak AND d = 'YES' THEN least(c, 0.7::DOUBLE) ELSE c END AS c, CASE WHEN weak AND d = 'YES' THEN list_append(guards, 'WEAK_RATIO_CONFIDENCE_CAP') ELSE guards END AS guards) FROM {last})")
    out.append("v AS (SELECT * REPLACE (CASE WHEN d = 'NO' THEN 'NONE' WHEN d = 'UNCERTAIN' AND s IN ('HIGH', 'CRITICAL') THEN 'MEDIUM' WHEN d = 'YES' AND s = 'NONE' THEN 'LOW' ELSE s END AS s) FROM w)")
    out.append("n AS (SELECT *, CASE WHEN d IN ('NO', 'UNCERTAIN') AND a = 'save_for_dataset' THEN a WHEN d = 'NO' THEN 'ignore' WHEN d = 'UNCERTAIN' THEN 'review_only' WHEN s IN ('HIGH', 'CRITICAL') THEN 'urgent_alert' ELSE 'alert_operator' END AS normal FROM v)")
    return "WITH " + ", ".join(out) + " SELECT case_id, seq, price, CASE WHEN a <> normal THEN list_append(guards, 'RECOMMENDED_ACTION_NORMALIZED') ELSE guards END AS guards, c AS guarded_confidence, d AS guarded_decision, s AS guarded_severity, normal AS guarded_action FROM n"


@query("r04_guardrails", _guard_sql())
def _(spark, d):
    c = F.col
    checks = {
        "NO_ACTIVE_ANOMALY_RULES": c("supp") % 50 == 1, "VLM_PARSE_FALLBACK": c("part") % 13 == 0, "LLM_PARSE_FALLBACK": c("part") % 17 == 0, "LLM_USED_NON_VLM_FACTS": c("supp") % 7 == 0,
        "YES_WITHOUT_LLM_TRIGGER_RULE": c("part") % 2 == 1, "YES_WITHOUT_CONCRETE_VISUAL_FACTS": c("gate") == "homography_macro", "YES_WITH_UNUSABLE_IMAGE_QUALITY": c("supp") % 5 == 0,
        "YES_WITH_LLM_SUPPRESS_RULE": c("seq") % 4 == 0, "WEAK_RATIO_CONFIDENCE_CAP": _ratio() < O.WEAK_RATIO,
    }
    rows = V.results(spark, d).withColumn("action", F.when(c("seq") % 3 == 0, "save_for_dataset").when(c("seq") % 3 == 1, "alert_operator").otherwise("review_only"))
    return O.guarded(rows, "decision", "confidence", "severity", "action", checks).select(*KEY, "guards", "guarded_confidence", "guarded_decision", "guarded_severity", "guarded_action")


@query("r05_rule_types", f"""SELECT id, rule_type, kind, CASE kind WHEN 'suppress' THEN 'NO/NONE/ignore' ELSE 'MEDIUM/alert_operator' END AS effect FROM (SELECT id, rule_type,
    CASE WHEN lower(trim(rule_type)) IN {tuple(O.RULE_TYPES["suppress"])!r} THEN 'suppress' ELSE 'trigger' END AS kind FROM rules)""")
def _(spark, d):
    rows = V.rules(spark, d).select("id", "rule_type", O.rule_type(F.col("rule_type")).alias("kind"))
    return rows.withColumn("effect", O.default_effect(F.col("kind")))


@query("m18_severities_and_actions", """WITH x AS (SELECT case_id, seq, price, coalesce(decision, 'UNCERTAIN') AS d, CASE part % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'odd' END AS s FROM results),
    y AS (SELECT *, CASE WHEN d = 'NO' THEN 'NONE' WHEN d = 'UNCERTAIN' AND s IN ('HIGH', 'CRITICAL') THEN 'MEDIUM' WHEN d = 'YES' AND s = 'NONE' THEN 'LOW' ELSE s END AS capped FROM x)
    SELECT case_id, seq, price, CASE s WHEN 'NONE' THEN 0 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 1 END AS rank, CASE WHEN s IN ('HIGH', 'CRITICAL') THEN s ELSE 'MEDIUM' END AS raised, capped,
    CASE WHEN d = 'NO' THEN 'ignore' WHEN d = 'UNCERTAIN' THEN 'review_only' WHEN capped IN ('HIGH', 'CRITICAL') THEN 'urgent_alert' ELSE 'alert_operator' END AS action FROM y""")
def _(spark, d):
    six = F.col("part") % 6
    s = F.when(six == 0, "NONE").when(six == 1, "LOW").when(six == 2, "MEDIUM").when(six == 3, "HIGH").when(six == 4, "CRITICAL").otherwise("odd")
    rows = V.results(spark, d).withColumn("said", F.coalesce("decision", F.lit("UNCERTAIN"))).withColumn("s", s).withColumn("capped", O.severity_of_decision(F.col("said"), F.col("s")))
    return rows.select(*KEY, O.severity_rank(F.col("s")).alias("rank"), O.severity_at_least(F.col("s"), "MEDIUM").alias("raised"), "capped", O.action_of(F.col("said"), F.col("capped")).alias("action"))


@query("r06_event_type_of_rules", """WITH x AS (SELECT case_id, seq, price, CASE WHEN part % 4 <> 0 THEN decision = 'YES' END AS applied, CASE WHEN part % 3 = 0 THEN gate WHEN part % 3 = 1 THEN ' ' END AS event_type, CASE WHEN supp % 3 = 0 THEN [' ' || severity, gate] WHEN supp % 3 = 1 THEN [] END AS event_types FROM results),
    f AS (SELECT case_id, arg_min(coalesce(nullif(trim(event_type), ''), nullif(trim(event_types[1]), '')), (seq, price)) FILTER (WHERE coalesce(applied, true) AND coalesce(nullif(trim(event_type), ''), nullif(trim(event_types[1]), '')) IS NOT NULL) AS named FROM x GROUP BY 1),
    d AS (SELECT case_id, arg_max(coalesce(decision, ''), (ts, seq, price)) AS said FROM results GROUP BY 1)
    SELECT case_id, CASE WHEN said = 'YES' THEN coalesce(named, 'rule_matched_alert') WHEN said = 'NO' THEN 'no_rule_alert' ELSE 'requires_human_review' END AS event FROM f JOIN d USING (case_id)""")
def _(spark, d):
    part, supp, none = F.col("part") % 3, F.col("supp") % 3, F.array().cast("array<string>")
    rule = F.struct(
        "seq", "price", F.when(F.col("part") % 4 != 0, F.coalesce(F.col("decision") == "YES", F.lit(None).cast("boolean"))).alias("applied"),
        F.when(part == 0, F.col("gate")).when(part == 1, " ").alias("event_type"), F.when(supp == 0, F.array(F.concat(F.lit(" "), "severity"), F.col("gate"))).when(supp == 1, none).alias("event_types"),
    )
    cases = V.results(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"), F.max_by("decision", F.struct("ts", "seq", "price")).alias("said"))  # a case's results are few
    return cases.select("case_id", O.event_type_of(F.col("said"), F.col("rules")).alias("event"))


@query("r07_queue_predicate", f"""SELECT case_id, seq, price, CASE WHEN supp % 23 = 0 THEN 'deep_reasoning_disabled' WHEN gate <> 'deep' THEN 'not_deep_gate' WHEN seq < 2 THEN 'event_not_persistent' WHEN {_RATIO} IS NULL THEN 'invalid_threshold' WHEN {_RATIO} < 1.15 THEN 'ratio_below_minimum'
    WHEN part % 5 = 0 THEN 'evidence_required_but_missing' ELSE 'queued' END AS reason, {_RATIO} AS ratio FROM results""")
def _(spark, d):
    keys = F.when(F.col("part") % 5 != 0, F.array(F.lit("events/1/annotated_frame.jpg")))
    reason = O.queue_reason(F.col("supp") % 23 != 0, F.col("gate"), "deep", F.col("seq") >= 2, F.col("score"), F.col("threshold"), keys, 1.15)
    return V.results(spark, d).select(*KEY, reason.alias("reason"), _ratio().alias("ratio"))


@query("r08_suitability", """WITH f AS (SELECT user_id % 60 AS split, count(*) FILTER (WHERE value < 0.5) / count(*) AS removed, abs(count(*) FILTER (WHERE value > 50) / count(*) - count(*) FILTER (WHERE k > 50) / count(*)) AS ks, count(*) FILTER (WHERE value > 99.5) AS events,
        abs(corr(value, k)) AS correlation, max(n) / count(*) AS top_share FROM (SELECT *, count(*) OVER (PARTITION BY user_id % 60, user_id) AS n FROM logs) GROUP BY 1),
    g AS (SELECT split, [CASE WHEN removed <= 0.01 THEN 0 WHEN removed <= 0.05 THEN 1 ELSE 2 END, CASE WHEN ks <= 0.15 THEN 0 WHEN ks <= 0.30 THEN 1 ELSE 2 END, CASE WHEN events = 0 THEN 0 WHEN events <= 2 THEN 1 ELSE 2 END,
        CASE WHEN correlation < 0.25 THEN 0 WHEN correlation < 0.40 THEN 1 ELSE 2 END, CASE WHEN top_share <= 0.5 THEN 0 WHEN top_share <= 0.8 THEN 1 ELSE 2 END] AS g FROM f)
    SELECT split, CASE WHEN list_contains(g, 2) THEN 'not_proven' WHEN len(list_filter(g, lambda x: x = 1)) >= 2 THEN 'promising_with_review' ELSE 'suitable' END AS verdict FROM g""")
def _(spark, d):
    logs = V.logs(spark, d).withColumn("split", F.col("user_id") % 60)
    # by user first, so that a split's figures come from few rows
    parts = logs.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(a) for a, c in (("low", F.col("value") < 0.5), ("high", F.col("value") > 50), ("k_high", F.col("k") > 50), ("events", F.col("value") > 99.5))))
    sums = parts.groupBy("split").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in ("low", "high", "k_high")), F.sum("events").alias("events"), (F.max("n") / F.sum("n")).alias("top_share"))
    r = sums.join(logs.groupBy("split").agg(F.abs(F.corr("value", "k")).alias("correlation")), "split")
    figures = {"removed": F.col("low"), "ks": F.abs(F.col("high") - F.col("k_high")), "events": F.col("events"), "correlation": F.col("correlation"), "top_share": F.col("top_share")}
    return r.select("split", O.suitability(figures).alias("verdict"))


#: What is said of a result, by its row: things to be seen, scores, and both.
_SENTENCES = ["person near gate {n}", "man holding a knife, ratio {n}", "pose statistical deviation {n}", "score above threshold {n}", "Hand on the door, distance {n}", "scores of bodies {n}", " ", "KNN distance exceeds {n}", "a chair falls", "the embedding of a table"]
_SCORE = "regexp_matches(lower(trim(x)), '\\b(" + "|".join(T.SCORE_WORDS) + ")\\b') AND NOT regexp_matches(lower(trim(x)), '\\b(" + "|".join(T.CONCRETE_WORDS) + ")\\b')"


@query("r10_split_evidence", f"""WITH s AS (SELECT case_id, seq, price, [replace(({_SENTENCES!r})[part % 10 + 1], '{{n}}', CAST(part AS VARCHAR)), replace(({_SENTENCES!r})[supp % 10 + 1], '{{n}}', CAST(supp AS VARCHAR)), replace(({_SENTENCES!r})[(part + supp) % 10 + 1], '{{n}}', CAST(seq AS VARCHAR))] AS said FROM results)
    SELECT case_id, seq, price, list_filter(said, lambda x: NOT ({_SCORE})) AS visual, list_filter(said, lambda x: {_SCORE}) AS scores FROM s""")
def _(spark, d):
    pick = lambda k, n: F.replace(F.element_at(F.array(*map(F.lit, _SENTENCES)), (k % 10 + 1).cast("int")), F.lit("{n}"), n.cast("string"))
    part, supp = F.col("part"), F.col("supp")
    said = F.array(pick(part, part), pick(supp, supp), pick(part + supp, F.col("seq")))
    visual, scores = O.split_evidence(F.col("said"))
    return V.results(spark, d).withColumn("said", said).select(*KEY, visual.alias("visual"), scores.alias("scores"))


_KEYS = ["events/{n}/frames/frame_{n}.jpg", "events/{n}/tubelet_montage.jpg", "events/{n}/frames/frame_{m}.PNG", "clip{n}.mp4", "events/{n}/frames/frame_{m}.webp", "events/{n}/event_metadata.json", "events/{n}/annotated_frame.jpg", "notes{n}.txt"]
_KEY_LIST = "list_transform([event_id % 8, event_id % 5, (event_id // 3) % 8, event_id % 5, (event_id // 7) % 8], lambda k: replace(replace((" + repr(_KEYS) + ")[k + 1], '{n}', CAST(event_id % 13 AS VARCHAR)), '{m}', CAST(event_id % 11 * 10 AS VARCHAR)))"


@query("r11_evidence_keys", f"""WITH k AS (SELECT event_id, unnest({_KEY_LIST}) AS key, unnest(range(5)) AS pos FROM events),
    i AS (SELECT event_id, key, min(pos) AS pos FROM k WHERE regexp_matches(lower(key), '\\.(jpg|jpeg|png|webp)$') GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN regexp_matches(lower(key), '(^|/)frames/frame_[0-9]+\\.(jpg|jpeg|png|webp)$') THEN CAST(regexp_extract(lower(key), 'frame_([0-9]+)', 1) AS BIGINT) END AS frame FROM i),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY frame, key) AS a, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS b, count(frame) OVER (PARTITION BY event_id) AS frames FROM r)
    SELECT e.event_id, coalesce(k.keys, []) AS keys FROM events e LEFT JOIN (SELECT event_id, list(key ORDER BY CASE WHEN frames > 0 THEN a ELSE b END) AS keys FROM n WHERE CASE WHEN frames > 0 THEN frame IS NOT NULL AND a <= 2 ELSE b <= 2 END GROUP BY 1) k ON k.event_id = e.event_id""")
def _(spark, d):
    i = F.col("event_id")
    names = F.array(*map(F.lit, _KEYS))
    filled = F.transform(names, lambda k: F.replace(F.replace(k, F.lit("{n}"), (i % 13).cast("string")), F.lit("{m}"), (i % 11 * 10).cast("string")))
    e = V.table(spark, d, "events").withColumn("names", filled)
    keys = F.array(*(F.element_at("names", (k + 1).cast("int")) for k in (i % 8, i % 5, F.floor(i / 3) % 8, i % 5, F.floor(i / 7) % 8)))
    return e.withColumn("keys", keys).select("event_id", O.evidence_keys(F.col("keys"), ["tubelet_frame"], 2).alias("keys"))


@query("r13_candidate_choice", """WITH c AS (SELECT case_id, seq, price, score / 50 AS iou, confidence / 4 AS dist, confidence AS conf, (part % 10) / 10 AS valid FROM results),
    s AS (SELECT *, 3 * iou - 2 * dist + 0.5 * conf + 0.25 * valid AS z, count(*) OVER (PARTITION BY case_id) AS n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(z, 9) DESC, price) AS k FROM s)
    SELECT case_id, price, CASE WHEN iou < 0.2 THEN 'low_iou' WHEN n > 1 AND (iou < 0.45 OR conf < 0.55 OR valid < 0.85) THEN 'ambiguous' ELSE 'accepted' END AS verdict FROM r WHERE k = 1""")
def _(spark, d):
    c = V.results(spark, d).select("case_id", "price", (F.col("score") / 50).alias("iou"), (F.col("confidence") / 4).alias("dist"), F.col("confidence").alias("conf"), ((F.col("part") % 10) / 10).alias("valid"))
    return O.best_candidate(c, ["case_id"], "iou", "dist", "conf", "valid", "price").select("case_id", "price", "verdict")


_GATES = "CASE user_id % 4 WHEN 0 THEN 'pose' WHEN 1 THEN 'deep' WHEN 2 THEN 'homography_macro' ELSE 'edge' END"


@query("r14_event_construction", S.gate_sql(86400.0, f""", x AS (SELECT g.*, s.user_id, s.ts, first_value(g.seq) OVER w AS first_seq, first_value(s.ts) OVER w AS start FROM g JOIN scores s ON s.event_id = g.seq WINDOW w AS (PARTITION BY g.track ORDER BY g.seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
    v AS (SELECT *, {_GATES} AS gate FROM x WHERE emits)
    SELECT seq AS event_id, 'session:' || user_id % 25 || ':' || gate || ':track:' || track || ':' || first_seq || '-' || seq AS key, 'case:session:' || user_id % 25 || ':' || gate || ':track:' || track || ':' || first_seq || '-' || seq AS case_key, CASE gate WHEN 'deep' THEN 'medium' ELSE 'low' END AS severity,
    CASE gate WHEN 'pose' THEN 'rare_pose_articulation' WHEN 'deep' THEN 'deep_semantic_spatiotemporal_anomaly' WHEN 'homography_macro' THEN 'rare_macro_floor_motion' ELSE 'other' END AS event_type, round(epoch_us(start) / 1e6, 3) AS start, round(epoch_us(ts) / 1e6, 3) AS peak, smooth AS peak_score FROM v"""))
def _(spark, d):
    samples = S.samples(spark, d)
    out = gates.batch(samples, S.GATE)
    user = F.substring_index("track", "/", 1).cast("long")
    four = user % 4
    rows = out.join(samples.select("track", "seq", "at"), ["track", "seq"]).withColumns({"session": user % 25, "gate": F.when(four == 0, "pose").when(four == 1, "deep").when(four == 2, "homography_macro").otherwise("edge")})
    events = O.gate_events(rows, ["track"], "seq", "at", "session", "gate", "smooth", "emits", 16)
    return events.select(F.col("seq").alias("event_id"), "key", "case_key", "severity", "event_type", F.round("start", 3).alias("start"), F.round("peak", 3).alias("peak"), F.round("peak_score", 7).alias("peak_score"))


@query("r15_short_circuit", "SELECT case_id, seq, price, decision = 'NO' AND confidence >= 0.8 AS skips FROM results WHERE decision IS NOT NULL")
def _(spark, d):
    return V.results(spark, d).where("decision is not null").select(*KEY, ((F.col("decision") == "NO") & (F.col("confidence") >= 0.8)).alias("skips"))
