"""Guardrails, rule types, write intent and rule matching on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from watchplan.functions import text as T
from watchplan.operators import decisions as D
from watchplan.operators import mutations

FLAGS = ["no_rules", "vlm", "llm", "facts", "trigger", "visual", "image", "suppress", "weak"]
#: decision, confidence, severity, action, flags that hold -> decision, confidence, severity, action, guards
CASES = [
    (("YES", 0.9, "HIGH", "urgent_alert", []), ("YES", 0.9, "HIGH", "urgent_alert", [])),
    (("YES", 0.9, "HIGH", "urgent_alert", ["trigger"]), ("UNCERTAIN", 0.45, "LOW", "review_only", ["YES_WITHOUT_LLM_TRIGGER_RULE"])),
    (("YES", 0.9, "HIGH", "urgent_alert", ["vlm"]), ("UNCERTAIN", 0.3, "LOW", "review_only", ["VLM_PARSE_FALLBACK"])),
    (("NO", 0.9, "LOW", "ignore", ["llm", "no_rules"]), ("UNCERTAIN", 0.3, "LOW", "review_only", ["NO_ACTIVE_ANOMALY_RULES", "LLM_PARSE_FALLBACK"])),
    (("YES", 0.9, "HIGH", "urgent_alert", ["trigger", "visual", "suppress"]), ("UNCERTAIN", 0.45, "LOW", "review_only", ["YES_WITHOUT_LLM_TRIGGER_RULE"])),
    (("YES", 0.9, "LOW", "alert_operator", ["suppress", "weak"]), ("UNCERTAIN", 0.5, "LOW", "review_only", ["YES_WITH_LLM_SUPPRESS_RULE"])),
    (("YES", 0.9, "NONE", "alert_operator", ["weak"]), ("YES", 0.7, "LOW", "alert_operator", ["WEAK_RATIO_CONFIDENCE_CAP"])),
    (("NO", 0.8, "HIGH", "urgent_alert", ["trigger", "weak"]), ("NO", 0.8, "NONE", "ignore", ["RECOMMENDED_ACTION_NORMALIZED"])),
    (("NO", 0.8, "LOW", "save_for_dataset", []), ("NO", 0.8, "NONE", "save_for_dataset", [])),
    (("UNCERTAIN", None, "CRITICAL", None, []), ("UNCERTAIN", 0.3, "MEDIUM", "review_only", [])),
    ((None, 1.7, None, "review_only", ["facts"]), ("UNCERTAIN", 0.4, "LOW", "review_only", ["LLM_USED_NON_VLM_FACTS"])),
    (("YES", 1.7, "CRITICAL", "alert_operator", ["image"]), ("UNCERTAIN", 0.4, "LOW", "review_only", ["YES_WITH_UNUSABLE_IMAGE_QUALITY"])),
]


def test_guardrails(spark):
    rows = [(k, *c[:4], *(f in c[4] for f in FLAGS)) for k, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, d string, c double, s string, a string, " + ", ".join(f"{f} boolean" for f in FLAGS))
    got = D.guarded(df, "d", "c", "s", "a", {name: F.col(f) for name, f in zip(D.CAPS, FLAGS, strict=True)}).orderBy("k").collect()
    for (_, want), r in zip(CASES, got, strict=True):
        assert (r["guarded_decision"], r["guarded_confidence"], r["guarded_severity"], r["guarded_action"], r["guards"]) == want


@pytest.mark.parametrize(("said", "kind"), [("detect", "trigger"), (" Benign", "suppress"), ("normal", "suppress"), ("anything", "trigger"), (None, "trigger"), ("whitelist", "trigger")])
def test_rule_types(spark, said, kind):
    assert spark.range(1).select(D.rule_type(F.lit(said).cast("string")).alias("x")).first()["x"] == kind


def test_write_intent(spark):
    said = {
        "delete employee 5": True, "insert into employees values 1": True, "drop the anomaly_rules table": True, "remove the camera": True, "set threshold to 5": True, "grant access": True,
        "when was Ahmed first inserted?": False, "how many times was Lina logged in?": False, "delete the record that was added": False, "who can add people": False, "set": False, "show everything": False,
    }
    got = spark.createDataFrame([(q,) for q in said], "q string").select("q", T.write_intent(F.col("q")).alias("w")).collect()
    assert {r["q"]: r["w"] for r in got} == said


def test_concrete_visual(spark):
    said = [(["score above threshold"], False), (["a person lies on the floor."], True), (["deep gate score", "arms raised"], True), ([], False), (None, False)]
    got = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(said)], "k int, s array<string>").select("k", T.concrete_visual(F.col("s")).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == [v for _, v in said]


def test_matched_rules(spark):
    rules = spark.createDataFrame([
        (1, "trigger", "fight_detection", "Lobby", "Punches and kicks", True), (2, "ignore", "loitering", "all", "Guards wait", True), (3, "alert", "other", "garage", "Something odd", True),
        (4, "trigger", "weapon", None, "A knife or a gun", True), (5, "trigger", "fight_detection", "all", "", False),
    ], "rule int, rule_type string, event string, place string, text string, active boolean")
    seen = spark.createDataFrame([
        ("a", "Main Lobby", "fighting", "YES", "FAIR", ["two people struggle"]), ("b", "Main Lobby", "fighting", "NO", "FAIR", ["two people struggle"]), ("c", "Garage", "suspicious_motion", "UNCERTAIN", "FAIR", []),
        ("d", "Garage", "normal_activity", "YES", "FAIR", ["he holds a knife"]), ("e", "Main Lobby", "fighting", "YES", "UNUSABLE", ["two people struggle"]), ("f", None, "normal_activity", "YES", "FAIR", ["guards talk"]),
        ("g", "Garage", "running", "YES", "FAIR", ["he runs"]),
    ], "k string, site string, event string, decision string, quality string, evidence array<string>")
    got = sorted((r["k"], r["rule"]) for r in D.matched_rules(seen, rules).collect())
    # a: a name of the seen event; b: a trigger needs more than NO; c: suppression needs no evidence; d: a keyword; f: the site isn't known, a keyword; g: other, not benign
    assert got == [("a", 1), ("c", 2), ("d", 4), ("f", 2), ("g", 3)]


def test_rules_changed(spark):
    rules = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id long, active boolean")
    change = lambda *c: spark.createDataFrame(list(c), "id long, op string, at int")
    state = lambda df: {r["id"]: r["active"] for r in df.collect()}
    assert state(mutations.rules_changed(rules, change((1, "deactivate", 1), (3, "reactivate", 1), (4, "delete", 1), (4, "reactivate", 2)))) == {1: False, 2: True, 3: True}
    assert state(mutations.rules_changed(rules, change((None, "deactivate", 2), (1, "reactivate", 3), (2, "reactivate", 1)))) == {1: True, 2: False, 3: False, 4: False}
    assert state(mutations.rules_changed(rules, change((None, "delete", 1)))) == {}
    more = mutations.inserted(rules, spark.createDataFrame([(10,), (30_000,), (20,)], "at long"), "id", "at")
    assert {r["at"]: r["id"] for r in more.collect()} == {10: 5, 20: 6, 30_000: 7}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("sentence", "scores_only"),
    [
        ("person near gate 3", False), ("man holding a knife, ratio 2", True), ("man holds a knife, hand raised, ratio 2", False), ("pose statistical deviation", True), ("Pose score exceeds the threshold; motion and posture", True),
        ("score high while the BODY lies on the floor", False), ("scores of thresholds", False), ("deep gate confidence", False), ("", False), (None, False), ("knn-distance", True), ("embedding of the table", False),
    ],
)
def test_sentences_of_scores_only(spark, sentence, scores_only):
    assert one(spark, T.score_only(F.lit(sentence).cast("string"))) is scores_only


def test_split_evidence(spark):
    said = F.array(*map(F.lit, ["person near gate 3", "pose statistical deviation", "hand on the door, ratio 2"]))
    visual, scores = D.split_evidence(said)
    assert one(spark, visual) == ["person near gate 3", "hand on the door, ratio 2"] and one(spark, scores) == ["pose statistical deviation"]


@pytest.mark.parametrize(
    ("key", "index"),
    [("events/abc/frames/frame_007.jpg", 7), ("FRAMES/frame_12.WEBP", 12), ("events/1/tubelet_montage_3.jpg", 10**9), ("clip2.mp4", 10**9), ("frames/frame_3.mp4", 10**9), ("xframes/frame_3.jpg", 10**9), ("frames/frame_3.jpg.bak", 10**9), ("frames/frame_.jpg", 10**9)],
)
def test_frame_index(spark, key, index):
    assert one(spark, T.frame_index(F.lit(key))) == index


def test_evidence_keys(spark):
    keys = lambda *k: F.array(*map(F.lit, k))
    got = one(spark, D.evidence_keys(keys("a/frames/frame_10.jpg", "a/tubelet_montage.jpg", "a/frames/frame_2.png", "a/frames/frame_10.jpg", "a/frames/frame_1.mp4"), ["tubelet_frame"], 4))
    assert got == ["a/frames/frame_2.png", "a/frames/frame_10.jpg"]
    assert one(spark, D.evidence_keys(keys("a/x.jpg", "b.txt", "a/y.png", "a/x.jpg", "a/z.webp"), ["tubelet_frame"], 2)) == ["a/x.jpg", "a/y.png"]
    assert one(spark, D.evidence_keys(keys("a/tubelet_montage.jpg", "a/annotated_frame.jpg", "a/frames/frame_1.jpg"), ["annotated_frame", "tubelet_montage"], 4)) == ["a/annotated_frame.jpg", "a/tubelet_montage.jpg"]


def test_word_set_without_brackets_and_braces(spark):
    assert sorted(one(spark, T.word_set(F.lit("{Person} [near] (the) 'door'. {}")))) == ["door", "near", "person", "the"]


@pytest.mark.parametrize(
    ("video", "path", "label", "loose"),
    [
        ("Anomaly__7", "/dataset/normal/7", 1, 0), ("normal__7", "x", 0, None), ("7", "/data/anomaly_dataset/dataset/normal/7", 0, 0), ("7", "D:\\dataset\\Anomaly\\7", 1, 1), ("7", "/normal/7", None, 0), ("7", "/a/anomalous_7", None, 1),
        ("7", "/normals/7", None, 0), ("7", "/clips/7", None, None), (None, None, None, None), ("7", "/normal/anomaly/7", None, 1),
    ],
)
def test_labels_of_paths(spark, video, path, label, loose):
    v, p = F.lit(video).cast("string"), F.lit(path).cast("string")
    assert (one(spark, T.label_of(v, p)), one(spark, T.loose_label_of(p))) == (label, loose)


@pytest.mark.parametrize(
    ("decision", "rules", "want"),
    [
        ("yes", [(True, "fight_detection", None)], "fight_detection"), ("YES", [(False, "theft", None), (True, " ", ["loitering", "x"]), (True, "theft", None)], "loitering"), ("YES", [(None, "weapon", None)], "weapon"),
        ("YES", [(True, None, []), (True, "", None)], "rule_matched_alert"), ("YES", [], "rule_matched_alert"), ("YES", None, "rule_matched_alert"), ("NO", [(True, "theft", None)], "no_rule_alert"), ("UNCERTAIN", [(True, "theft", None)], "requires_human_review"), (None, [], "requires_human_review"),
    ],
)
def test_event_type_of_a_decision(spark, decision, rules, want):
    df = spark.createDataFrame([(decision, rules)], "d string, r array<struct<applied:boolean,event_type:string,event_types:array<string>>>")
    assert df.select(D.event_type_of(F.col("d"), F.col("r")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((True, "deep", True, 2.0, 1.0, ["k"]), "queued"), ((False, "pose", False, 0.0, 0.0, []), "deep_reasoning_disabled"), ((None, "deep", True, 2.0, 1.0, ["k"]), "deep_reasoning_disabled"), ((True, "pose", False, 2.0, 1.0, []), "not_deep_gate"), ((True, None, True, 2.0, 1.0, ["k"]), "not_deep_gate"),
        ((True, "deep", False, 2.0, 0.0, []), "event_not_persistent"), ((True, "deep", True, 2.0, 0.0, []), "invalid_threshold"), ((True, "deep", True, 2.0, None, ["k"]), "invalid_threshold"), ((True, "deep", True, 2.0, -1.0, ["k"]), "invalid_threshold"),
        ((True, "deep", True, 1.1, 1.0, []), "ratio_below_minimum"), ((True, "deep", True, 1.15, 1.0, []), "evidence_required_but_missing"), ((True, "deep", True, 1.15, 1.0, None), "evidence_required_but_missing"),
    ],
)
def test_queue_reasons(spark, row, want):
    df = spark.createDataFrame([row], "e boolean, g string, p boolean, s double, t double, k array<string>")
    c = F.col
    assert df.select(D.queue_reason(c("e"), c("g"), "deep", c("p"), c("s"), c("t"), c("k"), 1.15).alias("x")).first()["x"] == want


def test_events_of_a_gate(spark):
    rows = spark.createDataFrame([("7", k, 100.0 + k, 3, "deep" if k < 6 else "pose", k / 10, k in (2, 5, 6)) for k in range(8)], "track string, seq long, at double, session int, gate string, smooth double, emits boolean")
    got = D.gate_events(rows, ["track"], "seq", "at", "session", "gate", "smooth", "emits", 4).orderBy("seq").collect()
    assert [(r.key, r.severity, r.event_type, r.start, r.peak, r.peak_score) for r in got] == [
        ("session:3:deep:track:7:0-2", "medium", "deep_semantic_spatiotemporal_anomaly", 100.0, 102.0, 0.2), ("session:3:deep:track:7:2-5", "medium", "deep_semantic_spatiotemporal_anomaly", 102.0, 105.0, 0.5), ("session:3:pose:track:7:3-6", "low", "rare_pose_articulation", 103.0, 106.0, 0.6),
    ]
    assert got[0].case_key == "case:" + got[0].key


def test_guardrails_plan_is_linear(spark):
    """The plan of all checks stays small: nothing is repeated for each check after it."""
    df = spark.createDataFrame([("YES", 0.9, "HIGH", "urgent_alert", True)], "d string, c double, s string, a string, f boolean")
    plan = D.guarded(df, "d", "c", "s", "a", {name: F.col("f") for name in D.CAPS})._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
