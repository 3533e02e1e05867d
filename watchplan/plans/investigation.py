"""The catalogue of named investigation queries: name and parameters to a plan.

run() takes the parameters that a query declares and leaves out others, so a caller may pass what it
has.  `now` is a parameter, never the clock.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchplan.operators import filters as O
from watchplan.operators import joins as J
from watchplan.operators.matching import cosine
from watchplan.plans import views as V

CATALOGUE: dict[str, Callable[..., DataFrame]] = {}
NOW = "2024-01-31"


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    CATALOGUE[f.__name__] = f
    return f


def run(name: str, spark: SparkSession, sf_dir: str, /, **params) -> DataFrame:
    f = CATALOGUE[name]
    known = inspect.signature(f).parameters
    needed = [p for p, v in known.items() if v.default is v.empty and p not in ("spark", "d") and params.get(p) is None]
    if needed:
        raise ValueError(f"{name} needs {', '.join(needed)}")
    return f(spark, sf_dir, **{k: v for k, v in params.items() if k in known and v is not None})


def _limited(df: DataFrame, order: list[Column], limit: object, default: int, cap: int) -> DataFrame:
    n = O.clamp(limit, default, cap)
    df = df.orderBy(*order)
    return df if n is None else df.limit(n)


def _seen(spark: SparkSession, d: str) -> DataFrame:
    """Recognitions with person and camera labels."""
    p = V.people(spark, d).withColumnRenamed("id", "person_id").withColumnRenamed("name", "enrolled_name")
    c = V.cameras(spark, d).select(F.col("id").alias("cid"), F.col("name").alias("camera_name"))
    rows = J.star(V.logs(spark, d), [(p, "detected_id", "person_id"), (c, "camera_id", "cid")])
    return rows.withColumn("person", F.coalesce("employee_name", "visitor_name", "enrolled_name")).withColumn("camera", F.coalesce("camera_name", F.format_string("Camera %d", "camera_id")))


_NAMES = ["employee_name", "visitor_name", "enrolled_name"]


@tool
def person_last_seen(spark, d, name: str, date: str | None = None):
    rows = _seen(spark, d).where(O.all_of([F.col("person_id").isNotNull(), O.named(name, _NAMES), O.on_day("ts", date)]))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(1).select("id", "ts", "person", "camera")


@tool
def person_first_seen(spark, d, name: str, date: str | None = None):
    rows = _seen(spark, d).where(O.all_of([F.col("person_id").isNotNull(), O.named(name, _NAMES), O.on_day("ts", date)]))
    return rows.orderBy("ts", "id").limit(1).select("id", "ts", "person", "camera")


@tool
def person_timeline(spark, d, name: str, days_back: int = 7, limit: object = 200, now: str = NOW):
    rows = _seen(spark, d).where(O.all_of([F.col("person_id").isNotNull(), O.named(name, _NAMES), O.since("ts", now, days_back)]))
    return _limited(rows, [F.desc("ts"), F.desc("id")], limit, 200, 200).select("id", "ts", "person", "camera")


@tool
def people_seen_on_date(spark, d, date: str = "2024-01-15", limit: object = 100):
    from watchplan.catalog.aggregates import people_seen_on_date as seen

    return _limited(seen(spark, d, date), [F.desc("seen"), F.asc("id")], limit, 100, 100)


@tool
def known_people(spark, d, limit: object = 50):
    n = O.clamp(limit, 50, 200)
    p = V.people(spark, d)
    part = lambda kind, c: p.where(F.col(c).isNotNull()).orderBy(c, "id").limit(n or 200).select(F.lit(kind).alias("kind"), "id", F.col(c).alias("name"))
    return part("employee", "employee_name").unionByName(part("visitor", "visitor_name")).unionByName(part("enrolled", "name"))


def _counted(spark, d, which: Column | None, name: str, date, days_back, hour, now):
    return V.logs(spark, d).where(O.all_of([which, O.on_day("ts", date), O.since("ts", now, days_back), O.at_hour("ts", hour)])).agg(F.count(F.lit(1)).alias(name))


@tool
def count_unknown_detections(spark, d, date: str | None = None, days_back: int | None = None, hour: int | None = None, now: str = NOW):
    return _counted(spark, d, F.col("detected_id").isNull(), "unknown", date, days_back, hour, now)


@tool
def count_known_detections(spark, d, date: str | None = None, days_back: int | None = None, hour: int | None = None, now: str = NOW):
    rows = _seen(spark, d).where(O.all_of([O.any_of(F.col(c).isNotNull() for c in _NAMES), O.on_day("ts", date), O.since("ts", now, days_back), O.at_hour("ts", hour)]))
    return rows.agg(F.count(F.lit(1)).alias("known"))


@tool
def count_all_detections(spark, d, date: str | None = None, days_back: int | None = None, hour: int | None = None, now: str = NOW):
    return _counted(spark, d, None, "every", date, days_back, hour, now)


@tool
def unknown_face_events(spark, d, camera_id: int | None = None, days_back: int | None = None, limit: object = 50, now: str = NOW):
    rows = _seen(spark, d).where(O.all_of([F.col("detected_id").isNull(), O.equals("camera_id", camera_id), O.since("ts", now, days_back)]))
    return _limited(rows, [F.desc("ts"), F.desc("id")], limit, 50, 200).select("id", "ts", "camera", "quality")


@tool
def unknown_face_details(spark, d, event_id: int):
    return _seen(spark, d).where((F.col("id") == event_id) & F.col("detected_id").isNull()).select("id", "ts", "camera", "quality", "processing_ms")


def _similar(spark, d, event_id: int, least: float, limit: object, cap: int) -> DataFrame:
    v = V.vectors(spark, d)
    one = v.where(F.col("vec_id") == event_id).select(F.col("v").alias("q"))
    rows = v.where(F.col("vec_id") != event_id).crossJoin(F.broadcast(one)).withColumn("similarity", cosine(F.col("q"), F.col("v")))  # one row
    return _limited(rows.where(F.col("similarity") >= least), [F.round("similarity", 12).desc(), F.asc("vec_id")], limit, 10, cap)


@tool
def similar_unknown_faces(spark, d, event_id: int, threshold: float = 0.60, limit: object = 10):
    return _similar(spark, d, event_id, threshold, limit, 50).select("vec_id", F.round("similarity", 6).alias("similarity"))


@tool
def possible_identity_match(spark, d, event_id: int, threshold: float = 0.55, limit: object = 5):
    p = V.people(spark, d).select(F.col("id").alias("label"), F.coalesce("employee_name", "visitor_name", "name").alias("person"))
    rows = _similar(spark, d, event_id, threshold, limit, 20)
    return rows.join(p, "label", "left").select("vec_id", "label", "person", F.round("similarity", 6).alias("similarity"))


@tool
def investigate_unknown_face(spark, d, event_id: int, threshold: float | None = None):
    """The event, faces like it and who it may be; threshold: for both searches, if not their own."""
    own = {} if threshold is None else {"threshold": threshold}
    a = similar_unknown_faces(spark, d, event_id, **own).select(F.lit("similar").alias("kind"), F.col("vec_id").alias("id"), "similarity")
    b = possible_identity_match(spark, d, event_id, **own).select(F.lit("identity").alias("kind"), F.col("label").alias("id"), "similarity")
    return a.unionByName(b).unionByName(unknown_face_details(spark, d, event_id).select(F.lit("event").alias("kind"), "id", F.lit(None).cast("double").alias("similarity")))


def _page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


@tool
def pending_unknowns(spark, d, limit: int = 50, offset: int = 0):
    """Unknown faces that nobody has decided on, newest first."""
    rows = V.logs(spark, d).where("detected_id is null and authorized is null")
    return _page(rows, [F.desc("ts"), F.desc("id")], limit, offset).select("id", "ts", "camera_id", "quality", "event_type")


@tool
def recent_logs(spark, d, limit: int = 50, offset: int = 0):
    """The last recognitions with their identity, newest first."""
    p = V.people(spark, d).select(F.col("id").alias("pid"), F.col("name").alias("identity"))
    rows = _page(V.logs(spark, d), [F.desc("ts"), F.desc("id")], limit, offset)
    return rows.join(p, F.col("detected_id") == F.col("pid"), "left").select("id", "ts", "detected_id", "identity", "camera_id", "authorized", "similarity", "margin")


@tool
def log_by_id(spark, d, log_id: int):
    p = V.people(spark, d).select(F.col("id").alias("pid"), F.col("name").alias("identity"))
    rows = V.logs(spark, d).where(F.col("id") == log_id)
    return rows.join(p, F.col("detected_id") == F.col("pid"), "left").select("id", "ts", "detected_id", "identity", "camera_id", "quality")


@tool
def max_similarity_for_identity(spark, d, event_id: int, label: int):
    """The greatest similarity of a vector with any other of an identity; no row for an identity without one."""
    v = V.vectors(spark, d)
    one = v.where(F.col("vec_id") == event_id).select(F.col("v").alias("q"))
    rows = v.where((F.col("label") == label) & (F.col("vec_id") != event_id)).crossJoin(F.broadcast(one))  # one row
    return rows.groupBy("label").agg(F.round(F.max(cosine(F.col("q"), F.col("v"))), 6).alias("similarity"))


@tool
def joined_jobs(spark, d, status: str | None = None, decision: str | None = None, case_id: int | None = None, limit: object = 50):
    """Reasoning jobs with their case and result, newest first."""
    a = V.cases(spark, d).select("id", F.col("status").alias("case_status"), "camera_id")
    rows = V.results(spark, d).withColumn("status", F.when(F.col("decision").isNull(), "failed").otherwise("succeeded"))
    rows = rows.where(O.all_of([O.equals("status", status), O.equals("decision", decision), O.equals("case_id", case_id)]))
    top = _limited(rows, [F.desc("ts"), F.desc("price")], limit, 50, 500)
    return top.join(a, top["case_id"] == a["id"]).select("case_id", "seq", "status", "decision", "case_status", "camera_id", "ts", "price")


def _with_camera(df: DataFrame, spark, d) -> DataFrame:
    c = V.cameras(spark, d).select(F.col("id").alias("cid"), F.col("name").alias("camera"))
    return df.join(c, F.col("camera_id") == F.col("cid"), "left")


@tool
def vad_cases(spark, d, status: str | None = None, severity: str | None = None, camera_id: int | None = None, limit: object = 20):
    rows = V.cases(spark, d).where(O.all_of([O.equals("status", status), O.equals("severity", severity.lower() if severity else None), O.equals("camera_id", camera_id)]))
    return _with_camera(_limited(rows, [F.desc("start_ts"), F.desc("id")], limit, 20, 200), spark, d).select("id", "status", "severity", "start_ts", "camera")


@tool
def vad_case_details(spark, d, case_id: int):
    r = J.latest_by_max(V.results(spark, d).where(F.col("case_id") == case_id), ["case_id"], ["ts", "seq", "price"], ["decision", "gate"])
    a = V.cases(spark, d).where(F.col("id") == case_id)
    return a.join(r, a["id"] == r["case_id"], "left").select("id", "status", "severity", "decision", "gate", "ts", "price")


@tool
def vad_gate_events(spark, d, gate: str | None = None, limit: object = 50):
    from watchplan.functions.text import gate_name

    rows = V.results(spark, d).where(O.all_of([None if gate is None else gate_name(F.col("gate")) == gate]))
    return _limited(rows, [F.desc("ts"), F.desc("price")], limit, 50, 200).select("case_id", "seq", "gate", "score", "ts", "price")


@tool
def vad_reasoning_jobs(spark, d, status: str | None = None, limit: object = 50):
    rows = V.results(spark, d).withColumn("status", F.when(F.col("decision").isNull(), "failed").otherwise("succeeded"))
    return _limited(rows.where(O.all_of([O.equals("status", status)])), [F.desc("ts"), F.desc("price")], limit, 50, 200).select("case_id", "seq", "status", "ts", "price")


@tool
def vad_reasoning_results(spark, d, decision: str | None = None, severity: str | None = None, limit: object = 50):
    """Severities are compared in upper case, as they are stored."""
    rows = V.results(spark, d).where(O.all_of([O.equals("decision", decision), None if severity is None else F.upper("severity") == severity.upper()]))
    return _limited(rows, [F.desc("ts"), F.desc("price")], limit, 50, 200).select("case_id", "seq", "decision", F.upper("severity").alias("severity"), "price")


@tool
def vad_case_reviews(spark, d, case_id: int | None = None, limit: object = 50):
    rows = V.cases(spark, d).where(O.all_of([F.col("status") == "reviewing", O.equals("id", case_id)]))
    return _limited(rows, [F.desc("start_ts"), F.desc("id")], limit, 50, 200).select("id", "severity", "start_ts")


@tool
def vad_case_gate_events(spark, d, case_id: int):
    a = V.cases(spark, d).where(F.col("id") == case_id)
    rows = a.join(V.results(spark, d).drop("severity", "score"), F.col("case_id") == F.col("id"))
    return _with_camera(rows, spark, d).select("id", "seq", "gate", "ts", "camera", "price").orderBy("ts", "price")


@tool
def vad_case_evidence(spark, d, case_id: int):
    line, part = V.table(spark, d, "lineitem").where(F.col("l_orderkey") == case_id), V.table(spark, d, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"], "left").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("seq"), F.col("p_name").alias("media"), F.col("l_extendedprice").alias("price"))


@tool
def vad_gate_scores(spark, d, case_id: int):
    ev = V.cases(spark, d).where(F.col("id") == case_id).select("id", (F.col("id") % 97).alias("a"), (F.col("id") % 89).alias("b"), (F.col("id") % 97 + 1).alias("c"))
    return J.any_id(ev, ["a", "b", "c"], V.scores(spark, d).select(F.col("event_id").alias("score_id"), "score"), "score_id").select("id", "score_id", "score").orderBy(F.desc_nulls_last("score"), F.desc("score_id"))


@tool
def vad_streams(spark, d, limit: object = 50):
    n = V.logs(spark, d).groupBy("camera_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    return _limited(n, [F.asc("camera_id")], limit, 50, 200)


@tool
def vad_stream_sessions(spark, d, camera_id: int | None = None, limit: object = 50):
    n = V.logs(spark, d).where(O.all_of([O.equals("camera_id", camera_id)])).groupBy("camera_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("frames"))
    return _limited(n, [F.desc("started"), F.asc("camera_id")], limit, 50, 200)


@tool
def cameras(spark, d, limit: object = 100):
    return _limited(V.cameras(spark, d), [F.asc("id")], limit, 100, 500)


@tool
def edge_devices(spark, d, limit: object = 100):
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("online"))
    return _limited(s, [F.asc("id")], limit, 100, 500)


@tool
def anomaly_rules(spark, d, place: str | None = None, limit: object = 50):
    rows = V.rules(spark, d).where(O.all_of([None if place is None else F.lower("place").contains(place.lower())]))
    return _limited(rows, [F.asc("id")], limit, 50, 200).select("id", "rule_type", "event", "place", "text")


@tool
def reasoning_rules(spark, d, gate: str | None = None, limit: object = 50):
    rows = V.rules(spark, d).where(O.all_of([None if gate is None else F.array_contains(F.split("gates", ","), gate)]))
    return _limited(rows, [F.asc("id")], limit, 50, 200).select("id", "gates", "min_ratio", "max_ratio", "needs_evidence")


@tool
def rule_conflicts(spark, d, limit: object = 50):
    n, rules = O.clamp(limit, 50, 200), V.rules(spark, d)
    return J.conflicting_rules(rules).orderBy("a", "b") if n is None else J.first_conflicts(rules, n)


@tool
def schedules(spark, d, limit: object = 50):
    hours = V.logs(spark, d).where("detected_id is not null").groupBy("detected_id").agg(F.min(F.hour("ts")).alias("from_hour"), F.max(F.hour("ts")).alias("to_hour"))
    return _limited(hours, [F.asc("detected_id")], limit, 50, 200)


@tool
def audit_logs(spark, d, action: str | None = None, limit: object = 50):
    rows = V.logs(spark, d).where(O.all_of([None if action is None else F.upper("event_type") == action.upper()]))
    return _limited(rows, [F.desc("ts"), F.desc("id")], limit, 50, 500).select("id", "ts", F.upper("event_type").alias("action"))


@tool
def table_counts(spark, d):
    from functools import reduce

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    return reduce(DataFrame.unionByName, [V.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in names]).orderBy(F.desc("n"), "name")


@tool
def daily_summary(spark, d, date: str = "2024-01-15"):
    a = V.logs(spark, d).where(O.on_day("ts", date)).agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("detected_id").isNull()).alias("unknown"), F.count_distinct("detected_id").alias("people"), F.round(F.avg("quality"), 3).alias("avg_quality"))
    b = V.cases(spark, d).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "open").alias("open_cases"))
    return a.crossJoin(b)  # one row each


@tool
def camera_activity(spark, d, days_back: int = 7, limit: object = 20, now: str = NOW):
    n = V.logs(spark, d).where(O.all_of([O.since("ts", now, days_back)])).groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("detected_id").isNull()).alias("unknown"))
    rows = _with_camera(n, spark, d).select("camera_id", F.coalesce("camera", F.format_string("Camera %d", "camera_id")).alias("camera"), "n", "unknown")
    return _limited(rows, [F.desc("n"), F.asc("camera_id")], limit, 20, 100)


@tool
def identities(spark, d, limit: object = 50, offset: int = 0):
    """People with their stored vectors, and how many of these are authoritative; vectors are counted by label before the join."""
    n = V.vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("embeddings"), F.count_if(F.col("vec_id") % 3 == 1).alias("authoritative"))
    page = V.people(spark, d).orderBy(F.desc("id")).offset(int(offset)).limit(O.clamp(limit, 50, 500) or 500)
    return page.join(n, F.col("id") % 12 == F.col("label"), "left").select("id", "name", F.coalesce("embeddings", F.lit(0)).alias("embeddings"), F.coalesce("authoritative", F.lit(0)).alias("authoritative"))


def _models(spark, d):
    key = F.col("s_suppkey")
    gate = F.when(key % 3 == 0, "pose").when(key % 3 == 1, "deep").otherwise("homography_macro")
    return V.table(spark, d, "supplier").select(key.alias("id"), gate.alias("gate"), F.col("s_name").alias("version"), (F.col("s_acctbal") > 0).alias("active"), F.when(key % 4 > 0, F.floor(F.col("s_acctbal") / 500)).alias("activated"))


@tool
def active_model(spark, d, gate: str):
    """The active model of a gate that was activated last (never: last of all), of equals the one with the greatest id."""
    rows = _models(spark, d).where(F.col("active") & (F.col("gate") == gate))
    return rows.orderBy(F.desc_nulls_last("activated"), F.desc("id")).limit(1).select("id", "gate", "version", "activated")


@tool
def primary_threshold(spark, d, model: int):
    key = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(key.alias("id"), (key % 100).alias("model"), F.col("p_size").alias("percentile"), F.col("p_retailprice").alias("value"), (key % 3 == 0).alias("is_primary"))
    return rows.where(F.col("is_primary") & (F.col("model") == int(model))).orderBy(F.desc("id")).limit(1).select("id", "model", "percentile", "value")


@tool
def event_evidence(spark, d, event_id: int):
    """Media of an event's evidence, by rank."""
    items = V.results(spark, d).where(F.col("case_id") == int(event_id)).select("case_id", "seq", "part", "price")
    media = V.table(spark, d, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("object_key"), F.col("p_type").alias("role"))
    return items.join(media, items["part"] == media["pk"]).orderBy("seq", "price").select("seq", "object_key", "role", "price")


def _jobs(spark, d):
    """Jobs with the metadata that names their event and gate."""
    meta = F.to_json(F.struct(F.col("case_id").alias("source_gate_event_id"), F.col("gate").alias("source_gate_name")))
    return V.results(spark, d).withColumn("metadata", meta)


def _of_event(event_id: int, gate: str | None) -> Column:
    same = F.get_json_object("metadata", "$.source_gate_event_id").cast("long") == int(event_id)
    return same if gate is None else same & (F.get_json_object("metadata", "$.source_gate_name") == gate)


@tool
def reasoning_jobs_of_event(spark, d, event_id: int, gate: str | None = None):
    return _jobs(spark, d).where(_of_event(event_id, gate)).orderBy(F.desc("ts"), F.desc("price")).select("case_id", "seq", "gate", "ts", "price")


@tool
def reasoning_results_of_event(spark, d, event_id: int):
    rows = _jobs(spark, d).where(_of_event(event_id, None) & F.col("decision").isNotNull())
    return rows.orderBy(F.desc("ts"), F.desc("price")).select("case_id", "seq", "decision", F.upper("severity").alias("severity"), "price")
