"""Decision operators: final decisions, guardrails, queue predicates, candidate choice, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchplan.functions import text as T
from watchplan.operators.joins import small

#: Severities in order, rule types by their other names, caps of the guardrails in their order.
SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
RULE_TYPES = {
    "trigger": ["trigger", "alert", "detect", "detection", "positive", "trigger_rule"],
    "suppress": ["suppress", "ignore", "benign", "normal", "negative", "suppress_rule"],
}
CAPS = {
    "NO_ACTIVE_ANOMALY_RULES": 0.35,
    "VLM_PARSE_FALLBACK": 0.30,
    "LLM_PARSE_FALLBACK": 0.30,
    "LLM_USED_NON_VLM_FACTS": 0.40,
    "YES_WITHOUT_LLM_TRIGGER_RULE": 0.45,
    "YES_WITHOUT_CONCRETE_VISUAL_FACTS": 0.45,
    "YES_WITH_UNUSABLE_IMAGE_QUALITY": 0.40,
    "YES_WITH_LLM_SUPPRESS_RULE": 0.50,
    "WEAK_RATIO_CONFIDENCE_CAP": 0.70,
}
#: Of these, the first FORCED hold whatever the decision is; the last one alone keeps a YES.
FORCED, KEEPS = 4, "WEAK_RATIO_CONFIDENCE_CAP"
WEAK_RATIO = 1.15
#: What a seen event may be called in rules, and seen events that are none.
EVENT_NAMES = {
    "fall_or_collapse": ["fall_detected"],
    "person_on_floor": ["fall_detected"],
    "physical_altercation": ["fight_detection"],
    "fighting": ["fight_detection"],
    "pushing_or_shoving": ["fight_detection"],
    "grappling_or_wrestling": ["fight_detection"],
    "aggressive_contact": ["fight_detection"],
    "rapid_unusual_movement": ["sudden_movement"],
    "suspicious_motion": ["intrusion", "loitering", "after_hours"],
    "possible_intrusion_or_security_event": ["intrusion", "after_hours", "unauthorized_access", "restricted_entry", "weapon", "weapon_detection", "theft", "stealing"],
    "unsafe_equipment_interaction": ["other", "equipment", "unsafe_equipment_interaction"],
    "deep_semantic_spatiotemporal_anomaly": ["other"],
}
BENIGN_EVENTS = ["normal_activity", "benign_object_movement", "benign_posture_change", "camera_or_detection_artifact"]
EVERYWHERE = ["", "all", "any", "anywhere"]


def final_decision(*places: Column) -> Column:
    """The first place that says something, in upper case; FAILED if none does."""
    return F.upper(F.coalesce(*(F.nullif(F.trim(p), F.lit("")) for p in places), F.lit("FAILED")))


def chosen(value: Column, mapping: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def rule_type(c: Column) -> Column:
    """trigger or suppress, by any of its names; trigger where it is none of them or missing."""
    return F.when(F.lower(F.trim(c)).isin(*RULE_TYPES["suppress"]), "suppress").otherwise("trigger")


def default_effect(kind: Column) -> Column:
    """What a rule of a type does unless it says otherwise."""
    return F.when(kind == "suppress", F.lit("NO/NONE/ignore")).otherwise(F.lit("MEDIUM/alert_operator"))


def severity_rank(c: Column) -> Column:
    """0 to 4; unknown severities count as LOW."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(c)), F.lit(0)).cast("int") - 1, F.lit(1))


def severity_at_least(c: Column, least: str) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(severity_rank(c), F.lit(SEVERITIES.index(least))) + 1)


def severity_of_decision(decision: Column, severity: Column) -> Column:
    """NONE for a NO, at most MEDIUM for what is uncertain, at least LOW for a YES."""
    high = severity.isin("HIGH", "CRITICAL")
    return F.when(decision == "NO", "NONE").when((decision == "UNCERTAIN") & high, "MEDIUM").when((decision == "YES") & (severity == "NONE"), "LOW").otherwise(severity)


def action_of(decision: Column, severity: Column) -> Column:
    return F.when(decision == "NO", "ignore").when(decision == "UNCERTAIN", "review_only").when(severity.isin("HIGH", "CRITICAL"), "urgent_alert").otherwise("alert_operator")


def guarded(df: DataFrame, decision: str, confidence: str, severity: str, action: str, checks: dict[str, Column]) -> DataFrame:
    """Guardrails in the order of CAPS: `guards` lists those that hold, the rest is guarded_decision, _confidence, _severity and _action.

    checks: a condition by the name of its guardrail; missing ones never hold.  Forced ones make any decision UNCERTAIN
    and LOW; the others look at a decision that is still YES and take it back, so that of these at most one holds;
    the weak ratio only caps the confidence of a YES that stays.  Caps add up to the least.  Missing decisions count as UNCERTAIN,
    missing severities as LOW, missing or zero confidences as 0.3; an action other than the normal one is listed.
    """
    said = F.upper(F.coalesce(F.col(decision), F.lit("UNCERTAIN")))
    holds = lambda name: F.coalesce(checks[name], F.lit(False)) if name in checks else F.lit(False)
    names = list(CAPS)
    forced = {n: holds(n) for n in names[:FORCED]}
    # of those that take a YES back, the first one that holds: after it there is no YES to look at
    taken = F.coalesce(*(F.when(holds(n), F.lit(n)) for n in names[FORCED:] if n != KEEPS))
    out = df.withColumns({"_said": said, "_any": F.greatest(*forced.values())})
    out = out.withColumn("_taken", F.when((F.col("_said") == "YES") & ~F.col("_any"), taken))
    out = out.withColumn("_down", F.col("_any") | F.col("_taken").isNotNull())
    out = out.withColumn("_keeps", (F.col("_said") == "YES") & ~F.col("_down") & holds(KEEPS))
    start = F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), F.lit(0.3))
    caps = [F.when(hit, F.lit(CAPS[n])) for n, hit in forced.items()] + [F.when(F.col("_taken") == n, F.lit(CAPS[n])) for n in names[FORCED:] if n != KEEPS] + [F.when(F.col("_keeps"), F.lit(CAPS[KEEPS]))]
    out = out.withColumn("guarded_confidence", F.least(F.greatest(start, F.lit(0.0)), F.lit(1.0), *caps))  # nulls don't count
    out = out.withColumn("guarded_decision", F.when(F.col("_down"), "UNCERTAIN").otherwise(F.col("_said")))
    first = F.when(F.col("_down"), "LOW").otherwise(F.upper(F.coalesce(F.col(severity), F.lit("LOW"))))
    out = out.withColumn("guarded_severity", severity_of_decision(F.col("guarded_decision"), first))
    out = out.withColumn("_wanted", F.when(F.col("_down"), "review_only").otherwise(F.coalesce(F.col(action), F.lit("review_only"))))
    kept = F.col("guarded_decision").isin("NO", "UNCERTAIN") & (F.col("_wanted") == "save_for_dataset")
    out = out.withColumn("guarded_action", F.when(kept, F.col("_wanted")).otherwise(action_of(F.col("guarded_decision"), F.col("guarded_severity"))))
    changed = F.when(F.col("_wanted") != F.col("guarded_action"), F.lit("RECOMMENDED_ACTION_NORMALIZED"))
    listed = [*(F.when(hit, F.lit(n)) for n, hit in forced.items()), F.col("_taken"), F.when(F.col("_keeps"), F.lit(KEEPS)), changed]
    return out.withColumn("guards", F.array_compact(F.array(*listed))).drop("_said", "_any", "_taken", "_down", "_keeps", "_wanted")


def matched_rules(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """seen with each rule (rule, rule_type) that fits it, no model asked.

    seen: site, event, decision, quality, evidence (sentences); rules: rule, rule_type, event, place, text, active.  A
    rule fits if its place is in the site's name or the other way round (or is everywhere, or the site unknown), and
    its event is the seen one or a name of it, or its words and the evidence's share a keyword.  A rule without event, or
    of 'other', fits any event that isn't benign.  Triggers need evidence and a decision that isn't NO; nothing fits
    an unusable image.  The rules are the small side; their size is checked before they are broadcast.
    """
    r = rules.where("active").select("rule", rule_type(F.col("rule_type")).alias("rule_type"), F.lower(F.trim(F.coalesce("event", F.lit("")))).alias("r_event"), F.lower(F.trim(F.coalesce("place", F.lit("")))).alias("r_place"), T.keywords(F.concat_ws(" ", "text", "text", "event")).alias("r_words"))
    names = F.create_map(*(F.lit(x) for k, v in EVENT_NAMES.items() for x in (k, v)))
    site, event = F.lower(F.trim(F.coalesce("site", F.lit("")))), F.lower(F.trim(F.coalesce("event", F.lit(""))))
    s = seen.where("quality <> 'UNUSABLE'").withColumn("_site", site).withColumn("_event", event).withColumn("_names", F.coalesce(names[event], F.array().cast("array<string>"))).withColumn("_words", T.keywords(F.concat_ws(" ", "evidence")))
    place = F.col("r_place").isin(*EVERYWHERE) | (F.col("_site") == "") | F.contains("_site", "r_place") | F.contains("r_place", "_site")
    any_event = F.col("r_event").isin("", "other")
    same = (any_event & ~F.col("_event").isin(*BENIGN_EVENTS)) | (~any_event & ((F.col("r_event") == F.col("_event")) | F.array_contains("_names", F.col("r_event"))))
    ready = (F.col("rule_type") == "suppress") | ((F.size("evidence") > 0) & F.col("decision").isin("YES", "UNCERTAIN"))
    fits = place & (same | F.arrays_overlap("r_words", "_words")) & ready
    return s.join(small(r), fits).drop("_site", "_event", "_names", "_words", "r_event", "r_place", "r_words")


def event_type_of(decision: Column, applied: Column) -> Column:
    """The event type that a final decision is shown by.

    applied: rules in order, structs of applied (false: not applied; null counts as applied), event_type and event_types.  A YES takes
    the first rule's that was applied and names one; without any it is rule_matched_alert.  A NO is no_rule_alert, all else
    requires_human_review.
    """
    named = lambda r: F.coalesce(F.nullif(F.trim(r["event_type"]), F.lit("")), F.nullif(F.trim(F.get(r["event_types"], F.lit(0))), F.lit("")))
    first = F.get(F.filter(F.transform(F.filter(applied, lambda r: F.coalesce(r["applied"], F.lit(True))), named), lambda n: n.isNotNull()), F.lit(0))
    said = F.upper(F.coalesce(decision, F.lit("UNCERTAIN")))
    return F.when(said == "YES", F.coalesce(first, F.lit("rule_matched_alert"))).when(said == "NO", "no_rule_alert").otherwise("requires_human_review")


def queue_reason(enabled: Column, gate: Column, wanted: str, lasting: Column, score: Column, threshold: Column, keys: Column, least_ratio: float, needs_evidence: bool = True) -> Column:
    """queued, or why an event isn't: the first reason in order of switch, gate, persistence, threshold, ratio, evidence.

    wanted: the gate whose queue this is.  A threshold that is missing, zero or below is invalid, as it has no ratio; keys: object keys of the evidence.
    """
    ratio = F.when(threshold > 0, score / threshold)
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), f"{wanted}_reasoning_disabled").when(~F.coalesce(gate == wanted, F.lit(False)), f"not_{wanted}_gate").when(~F.coalesce(lasting, F.lit(False)), "event_not_persistent")
        .when(ratio.isNull(), "invalid_threshold").when(ratio < least_ratio, "ratio_below_minimum")
        .when(F.lit(needs_evidence) & (F.coalesce(F.size(keys), F.lit(0)) < 1), "evidence_required_but_missing").otherwise("queued")
    )


#: The event type of a gate's events.
GATE_EVENTS = {"pose": "rare_pose_articulation", "deep": "deep_semantic_spatiotemporal_anomaly", "homography_macro": "rare_macro_floor_motion"}


def gate_events(rows: DataFrame, track: list[str], seq: str, at: str, session: str, gate: str, smooth: str, emits: str, length: int) -> DataFrame:
    """Events of a gate's rows that emit, from the window of `length` samples that ends there: key, case_key, severity, event_type, start, peak, peak_score.

    The window begins at the track's first sample where there are fewer.  The peak is the window's last sample, its score the smoothed one;
    severity is medium for the deep gate, else low.
    """
    w = Window.partitionBy(*track).orderBy(seq).rowsBetween(-(length - 1), 0)
    windows = rows.withColumns({"first_seq": F.first(seq).over(w), "start": F.first(at).over(w)}).where(emits)
    key = F.concat(F.lit("session:"), F.col(session).cast("string"), F.lit(":"), gate, F.lit(":track:"), F.concat_ws("/", *track), F.lit(":"), F.col("first_seq").cast("string"), F.lit("-"), F.col(seq).cast("string"))
    kinds = F.create_map(*(F.lit(x) for pair in GATE_EVENTS.items() for x in pair))
    out = windows.withColumns({"key": key, "severity": F.when(F.col(gate) == "deep", "medium").otherwise("low"), "event_type": F.coalesce(kinds[F.col(gate)], F.lit("other")), "peak": F.col(at), "peak_score": F.col(smooth)})
    return out.withColumn("case_key", F.concat(F.lit("case:"), "key"))


def best_candidate(df: DataFrame, by: list[str], iou: str, distance: str, confidence: str, valid: str, order: str) -> DataFrame:
    """The candidate with the greatest 3 iou - 2 distance + confidence / 2 + valid / 4, to nine digits, the first among equals, and whether it is accepted.

    Rejected: iou below 0.20; more than one candidate and iou < 0.45, confidence < 0.55 or valid < 0.85.
    """
    score = 3 * F.col(iou) - 2 * F.col(distance) + 0.5 * F.col(confidence) + 0.25 * F.col(valid)
    w = Window.partitionBy(*by)
    top = df.withColumn("score", score).withColumn("candidates", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.round("score", 9).desc(), order))).where("_r = 1").drop("_r")
    unsure = (F.col("candidates") > 1) & ((F.col(iou) < 0.45) | (F.col(confidence) < 0.55) | (F.col(valid) < 0.85))
    return top.withColumn("verdict", F.when(F.col(iou) < 0.20, "low_iou").when(unsure, "ambiguous").otherwise("accepted"))


def split_evidence(sentences: Column) -> tuple[Column, Column]:
    """(sentences that may stand as visual evidence, sentences of scores only): see functions.text.score_only."""
    return F.filter(sentences, lambda s: ~T.score_only(s)), F.filter(sentences, T.score_only)


def evidence_keys(keys: Column, roles: list[str], most: int) -> Column:
    """Distinct image keys of the given roles by frame number, then in order; the first `most` images if no key has such a role."""
    images = F.filter(F.array_distinct(keys), lambda k: k.rlike(r"(?i)\.(jpg|jpeg|png|webp)$"))
    good = F.filter(images, lambda k: T.evidence_role(k).isin(*roles))
    ordered = F.transform(F.array_sort(F.transform(good, lambda k: F.struct(T.frame_index(k).alias("n"), k.alias("k")))), lambda s: s["k"])
    return F.when(F.size(good) > 0, F.slice(ordered, 1, most)).otherwise(F.slice(images, 1, most))


def suitability(report: dict[str, Column]) -> Column:
    """Verdict over single-row figures: removed share, ks, events, correlation, top video's share."""
    grade = lambda c, good, fair: F.when(c <= good, 0).when(c <= fair, 1).otherwise(2)
    grades = [grade(report["removed"], 0.01, 0.05), grade(report["ks"], 0.15, 0.30), grade(report["events"], 0, 2), F.when(report["correlation"] < 0.25, 0).when(report["correlation"] < 0.40, 1).otherwise(2), grade(report["top_share"], 0.5, 0.8)]
    fails, warns = (sum(((g == k).cast("int") for g in grades), F.lit(0)) for k in (2, 1))
    return F.when(fails > 0, "not_proven").when(warns >= 2, "promising_with_review").otherwise("suitable")
