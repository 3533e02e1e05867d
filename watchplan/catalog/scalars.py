"""Queries of scalar functions (S*, D*, M-8, M-13..M-19, JS*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.functions import geometry as G
from watchplan.functions import text as T
from watchplan.functions import time as D
from watchplan.plans import views as V


@query("sc01_coalesce_chain", "SELECT id, coalesce(nullif(employee_name, ''), nullif(visitor_name, ''), name, 'Unknown') AS label FROM people")
def _(spark, d):
    return V.people(spark, d).select("id", F.coalesce(F.nullif("employee_name", F.lit("")), F.nullif("visitor_name", F.lit("")), "name", F.lit("Unknown")).alias("label"))


@query("sc03_squeezed", "SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7e\\n]', '', 'g'), '\\s+', ' ', 'g')))) AS h FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    ascii_ = F.regexp_replace("text", r"[^\x20-\x7e\n]", "")
    return V.table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.squeezed(ascii_).cast("binary")).alias("h"))


@query("sc04_keywords", "SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_]{3,}'), lambda x: NOT list_contains(" + repr(T.STOPWORDS) + ", x)))) AS words FROM benchmark")
def _(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.array_sort(T.keywords(F.col("text"))).alias("words"))


@query("sc05_word_set", "SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[.,;:!?()\\[\\]{}\"'']+|[.,;:!?()\\[\\]{}\"'']+$', '', 'g')), lambda w: w <> ''))) AS words FROM benchmark")
def _(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.array_sort(T.word_set(F.col("text"))).alias("words"))


_FRAME_KEY = "CASE page_id % 5 WHEN 0 THEN url || '/frames/frame_' || page_id || '.jpg' WHEN 1 THEN 'Frames/FRAME_0' || page_id || '.WebP' WHEN 2 THEN url || '/tubelet_montage_' || page_id || '.jpg' WHEN 3 THEN 'frames/frame_' || page_id || '.mp4' ELSE url END"


@query("sc06_frame_index", f"""WITH k AS (SELECT page_id, {_FRAME_KEY} AS key FROM pages), p AS (SELECT page_id, string_split(lower(key), '/') AS parts FROM k),
    n AS (SELECT page_id, parts[-1] AS name, parts[-2] AS folder FROM p) SELECT page_id, CASE WHEN folder = 'frames' AND regexp_full_match(name, 'frame_[0-9]+[.](jpg|jpeg|png|webp)') THEN CAST(string_split(substr(name, 7), '.')[1] AS BIGINT) ELSE 1000000000 END AS idx FROM n""")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.frame_index(F.expr(_FRAME_KEY)).alias("idx"))


@query("sc08_object_reference", "SELECT page_id, split_part(substr(r, 6), '/', 1) AS bucket, substr(r, 7 + length(split_part(substr(r, 6), '/', 1))) AS key FROM (SELECT page_id, 's3://evidence-' || page_id % 3 || '/faces/' || page_id || '.jpg' AS r FROM pages)")
def _(spark, d):
    r = F.concat(F.lit("s3://evidence-"), (F.col("page_id") % 3).cast("string"), F.lit("/faces/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    bucket, key = T.object_reference(r)
    return V.table(spark, d, "pages").select("page_id", bucket.alias("bucket"), key.alias("key"))


@query("sc09_gate_name", "SELECT gate, CASE WHEN contains(gate, 'homography') THEN 'homography' ELSE gate END AS name, count(*) AS n FROM results GROUP BY 1, 2")
def _(spark, d):
    return V.results(spark, d).groupBy("gate", T.gate_name(F.col("gate")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("sc11_labels", "SELECT id, 'session:' || camera_id || ':pose:track:' || track_id || ':' || id || '-' || (id + 7) AS key FROM cases")
def _(spark, d):
    return V.cases(spark, d).select("id", F.format_string("session:%d:pose:track:%d:%d-%d", "camera_id", "track_id", "id", F.col("id") + 7).alias("key"))


#: Ids and paths of videos, with the words in places that count and in places that don't.
_VIDEO = "CASE page_id % 7 WHEN 0 THEN ' Anomaly__' || page_id WHEN 1 THEN 'normal__' || page_id ELSE 'clip_' || page_id END"
_PATH = "CASE page_id % 6 WHEN 0 THEN '/data/anomaly_dataset/dataset/normal/' || page_id WHEN 1 THEN 'D:\\\\Dataset\\\\Anomaly\\\\' || page_id WHEN 2 THEN '/normal/' || page_id WHEN 3 THEN url || '/anomalous_' || page_id WHEN 4 THEN '/x/Normals/' || page_id ELSE url END"


@query("sc12_label_from_path", f"""WITH x AS (SELECT page_id, lower(trim({_VIDEO})) AS v, lower(replace({_PATH.replace(chr(92) * 2, chr(92))}, chr(92), '/')) AS p FROM pages), s AS (SELECT *, string_split(p, '/') AS parts FROM x)
    SELECT page_id, CASE WHEN v LIKE 'anomaly!_!_%' ESCAPE '!' THEN 1 WHEN v LIKE 'normal!_!_%' ESCAPE '!' THEN 0 WHEN p LIKE '%/dataset/anomaly/%' THEN 1 WHEN p LIKE '%/dataset/normal/%' THEN 0 END AS label,
    CASE WHEN list_has_any(parts, ['anomaly', 'anomalous']) THEN 1 WHEN list_contains(parts, 'normal') THEN 0 WHEN p LIKE '%anomaly%' OR p LIKE '%anomalous%' THEN 1 WHEN p LIKE '%normal%' THEN 0 END AS loose FROM s""")
def _(spark, d):
    rows = V.table(spark, d, "pages").select("page_id", F.expr(_VIDEO).alias("v"), F.expr(_PATH).alias("p"))
    return rows.select("page_id", T.label_of(F.col("v"), F.col("p")).alias("label"), T.loose_label_of(F.col("p")).alias("loose"))


@query("sc13_lenient_json", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN '{\"k\": ' || event_id || '}' END AS json FROM events")
def _(spark, d):
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n{\"k\": "), i, F.lit("}\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Result: {\"k\": "), i, F.lit(",}."))).otherwise(F.lit("no object here"))
    return V.table(spark, d, "events").select("event_id", T.lenient_json(raw).alias("json"))


@query("sc14_vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(v, lambda x: printf('%.8f', x)), ',') || ']' AS literal FROM vectors")
def _(spark, d):
    return V.vectors(spark, d).select("vec_id", T.vector_literal(F.col("v"), 8).alias("literal"))


_KEYS = ("ev/7/frames/frame_001.jpg", "/EV/8/Annotated_Frame.jpg", "ev/9/tubelet_montage.jpg", "event_metadata.json", "ev/9/clip.mp4", "ev/frames/frame_x.jpg")


@query("sc07_evidence_role", "SELECT event_id, ['tubelet_frame', 'annotated_frame', 'tubelet_montage', 'event_metadata', 'other', 'other'][event_id % 6 + 1] AS role FROM events")
def _(spark, d):
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % 6 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", T.evidence_role(key).alias("role"))


@query("sc15_content_hash", "SELECT page_id, sha256(html) AS sha FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))


@query("d05_interval_ms", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 60) * 1000.0 + 500 WHEN 1 THEN (3600 + (event_id % 60) * 60 + 7.25) * 1000 ELSE CAST(event_id AS DOUBLE) END AS ms FROM events")
def _(spark, d):
    m = (F.col("event_id") % 60).cast("string")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("PT"), m, F.lit(".5S"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("01:"), m, F.lit(":07.250"))).otherwise(F.col("event_id").cast("string"))
    return V.table(spark, d, "events").select("event_id", D.duration_ms(said).alias("ms"))


_SAID_DAY = "CASE o_orderkey % 5 WHEN 0 THEN 'today' WHEN 1 THEN 'Yesterday' WHEN 2 THEN o_orderpriority WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE NULL END"


@query("d08_relative_dates", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN DATE '2024-01-30' WHEN 3 THEN CAST(o_orderdate AS DATE) ELSE DATE '2024-01-31' END AS day FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", D.relative_date(F.expr(_SAID_DAY), "2024-01-31").alias("day"))


@query("d10_frame_seconds", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id / CAST(event_id % 4 AS DOUBLE) END AS sec FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", D.frame_seconds(F.col("event_id"), (F.col("event_id") % 4).cast("double")).alias("sec"))


_BOXES = "SELECT event_id, CAST(event_id % 40 AS DOUBLE) AS ax, CAST(event_id % 30 AS DOUBLE) AS ay, CAST(event_id % 40 + 20 AS DOUBLE) AS az, CAST(event_id % 30 + 15 AS DOUBLE) AS aw, CAST(event_id % 37 AS DOUBLE) AS bx, CAST(event_id % 23 AS DOUBLE) AS \"by\", CAST(event_id % 37 + 25 AS DOUBLE) AS bz, CAST(event_id % 23 + 10 AS DOUBLE) AS bw FROM events"


@query("m13_iou", f"WITH b AS ({_BOXES}), i AS (SELECT event_id, greatest(0, least(az, bz) - greatest(ax, bx)) * greatest(0, least(aw, bw) - greatest(ay, \"by\")) AS n FROM b) SELECT event_id, round(n / (20.0::DOUBLE * 15 + 25 * 10 - n), 9) AS iou FROM i")
def _(spark, d):
    i = F.col("event_id")
    a = tuple(x.cast("double") for x in (i % 40, i % 30, i % 40 + 20, i % 30 + 15))
    b = tuple(x.cast("double") for x in (i % 37, i % 23, i % 37 + 25, i % 23 + 10))
    return V.table(spark, d, "events").select("event_id", F.round(G.iou(a, b), 9).alias("iou"))


@query("m14_boxes", f"WITH b AS ({_BOXES}) SELECT event_id, greatest(0, ax - 2) AS x1, greatest(0, ay - 1.5) AS y1, least(50, az + 2) AS x2, least(40, aw + 1.5) AS y2, (ax + az) / 2 AS cx FROM b")
def _(spark, d):
    i = F.col("event_id")
    a = tuple(x.cast("double") for x in (i % 40, i % 30, i % 40 + 20, i % 30 + 15))
    c = G.clamped(a, 50, 40, 0.1)
    return V.table(spark, d, "events").select("event_id", *(x.alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)), G.bottom_centre(a)[0].alias("cx"))


_WRAPPED = "CASE WHEN round(atan2(sin(value), cos(value)), 7) <= -round(pi(), 7) THEN round(pi(), 7) ELSE round(atan2(sin(value), cos(value)), 7) END"


@query("m15_angle_wrap", f"SELECT event_id, {_WRAPPED} AS wrapped, {_WRAPPED} AS wrapped2 FROM events")
def _(spark, d):
    v, pi = F.col("value"), F.round(F.pi(), 7)
    one = lambda a: F.when(F.round(a, 7) <= -pi, pi).otherwise(F.round(a, 7))  # noqa: E731  # half a turn is pi, never -pi
    return V.table(spark, d, "events").select("event_id", one(G.wrapped_modulo(v)).alias("wrapped"), one(G.wrapped_atan2(v)).alias("wrapped2"))


@query("m16_score_ratio", "SELECT case_id, seq, price, CASE WHEN threshold > 0 THEN score / threshold ELSE CASE WHEN confidence > 0 THEN confidence END END AS ratio, CASE WHEN threshold > 0 AND score / threshold < 1.15 THEN 'weak' WHEN threshold > 0 AND score / threshold < 1.5 THEN 'moderate' WHEN threshold > 0 THEN 'strong' END AS band FROM results")
def _(spark, d):
    ratio = F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold"))
    band = F.when(ratio < 1.15, "weak").when(ratio < 1.5, "moderate").when(ratio.isNotNull(), "strong")
    return V.results(spark, d).select("case_id", "seq", "price", F.coalesce(ratio, F.when(F.col("confidence") > 0, F.col("confidence"))).alias("ratio"), band.alias("band"))


_H = [[1.5, 0.1, 3.0], [-0.2, 0.9, 1.0], [0.001, 0.002, 1.0]]


@query("m08_homography", "SELECT event_id, round((1.5 * x + 0.1 * y + 3.0) / w, 7) AS u, round((-0.2 * x + 0.9 * y + 1.0) / w, 7) AS v FROM (SELECT event_id, value AS x, CAST(user_id AS DOUBLE) AS y, 0.001 * value + 0.002 * user_id + 1.0 AS w FROM events)")
def _(spark, d):
    u, v = G.projected(_H, F.col("value"), F.col("user_id").cast("double"))
    return V.table(spark, d, "events").select("event_id", F.round(u, 7).alias("u"), F.round(v, 7).alias("v"))


@query("m19_in_polygon", "SELECT event_id, (x > 10 AND x < 60 AND y > 20 AND y < 90) AS inside FROM (SELECT event_id, value + 0.003 AS x, user_id + 0.5 AS y FROM events)")
def _(spark, d):
    p = G.in_polygon(F.col("value") + 0.003, F.col("user_id") + 0.5, [(10.0, 20.0), (60.0, 20.0), (60.0, 90.0), (10.0, 90.0)])
    return V.table(spark, d, "events").select("event_id", p.alias("inside"))


@query("m21_safe_casts", "SELECT c_custkey AS id, coalesce(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), -1) AS value FROM customer")
def _(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, "x").when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal").cast("string")).otherwise(F.col("c_acctbal").cast("string"))
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.nanvl(raw.try_cast("double"), F.lit(None).cast("double")), F.lit(-1.0)).alias("value"))


@query("js01_nested_extract", "SELECT event_id, CAST(json_extract_string('{\"a\": {\"b\": ' || json_extract_string(props, '$.k') || '}}', '$.a.b') AS BIGINT) AS b FROM events")
def _(spark, d):
    doc = F.concat(F.lit('{"a": {"b": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    return V.table(spark, d, "events").select("event_id", F.get_json_object(doc, "$.a.b").cast("long").alias("b"))


@query("js02_list_or_object", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END AS keys FROM events")
def _(spark, d):
    doc = F.when(F.col("event_id") % 2 == 0, F.lit('["a", "b"]')).otherwise(F.lit('{"keys": ["c"]}'))
    keys = F.coalesce(F.when(doc.startswith("["), F.from_json(doc, "array<string>")), F.from_json(doc, "keys array<string>")["keys"])
    return V.table(spark, d, "events").select("event_id", keys.alias("keys"))


@query("js03_json_merge", "SELECT event_id, 'new' AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 3 AS size FROM events")
def _(spark, d):
    left = F.create_map(F.lit("a"), F.lit("old"), F.lit("k"), F.get_json_object("props", "$.k"))
    both = T.merged(left, F.create_map(F.lit("a"), F.lit("new"), F.lit("z"), F.lit("1")))
    return V.table(spark, d, "events").select("event_id", both["a"].alias("a"), both["k"].cast("long").alias("k"), F.size(both).alias("size"))


@query("js05_array_membership", "SELECT user_id, list_contains(kinds, 'error') AS has_error FROM (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1)")
def _(spark, d):
    return V.table(spark, d, "events").groupBy("user_id").agg(F.array_contains(F.collect_set("event_type"), "error").alias("has_error"))


@query("js07_stripped", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS has_vector, 2 AS fields FROM events")
def _(spark, d):
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"), F.array(F.col("value"), F.lit(0.5)).alias("embedding"), F.lit("[0.1,0.2]").alias("vector")))
    left = T.without_keys(doc, ["embedding", "vector"])
    return V.table(spark, d, "events").select("event_id", F.get_json_object(left, "$.k").cast("long").alias("k"), left.rlike("embedding|vector").alias("has_vector"), F.json_array_length(F.to_json(F.map_keys(F.from_json(left, "map<string,string>")))).alias("fields"))


@query("js08_nested_job", """SELECT a.id, 'pose' AS gate, a.status, CAST(r.seq AS BIGINT) AS seq, r.decision FROM cases a JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, seq DESC, price DESC) AS n FROM results) r ON r.case_id = a.id AND r.n = 1""")
def _(spark, d):
    from watchplan.operators.joins import latest_by_max

    r = latest_by_max(V.results(spark, d), ["case_id"], ["ts", "seq", "price"], ["decision"])
    a = V.cases(spark, d)
    job = F.to_json(F.struct(F.lit("pose").alias("gate"), F.struct("id", "status").alias("case"), F.struct("seq", "decision").alias("result")))
    rows = a.join(r, a["id"] == r["case_id"]).select(job.alias("job"))  # one object for each job, case and result inside
    get = lambda p: F.get_json_object("job", p)
    return rows.select(get("$.case.id").cast("long").alias("id"), get("$.gate").alias("gate"), get("$.case.status").alias("status"), get("$.result.seq").cast("long").alias("seq"), get("$.result.decision").alias("decision"))


#: Questions about a part: commands, and questions of past changes.
_QUESTIONS = (
    "delete {x}", "who deleted {x} yesterday", "show all logs of {x}", "add a new camera for {x}", "when was the rule of {x} added", "insert into employees values {x}", "drop the {x} table", "when was {x} first inserted?",
    "how many times was {x} logged in?", "set {x} to 5", "Remove the schedule of {x}", "UPDATE {x}", "what did we set for {x}", "add {x}", "delete the {x} that was added", "grant {x} to me", "clear everything of {x}", "create a table of {x}",
)


@query("r12_write_intent", f"""WITH q AS (SELECT p_partkey, replace(({list(_QUESTIONS)!r})[p_partkey % {len(_QUESTIONS)} + 1], '{{x}}', p_name) AS question FROM part)
    SELECT p_partkey, question, NOT regexp_matches(question, '{T.PAST_PATTERN}', 'i') AND ({" OR ".join(f"regexp_matches(question, '{p}', 'i')" for p in T.WRITE_PATTERNS)}) AS writes FROM q""")
def _(spark, d):
    part = V.table(spark, d, "part")
    question = F.replace(F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("p_partkey") % len(_QUESTIONS) + 1).cast("int")), F.lit("{x}"), F.col("p_name"))
    return part.select("p_partkey", question.alias("question")).withColumn("writes", T.write_intent(F.col("question")))
