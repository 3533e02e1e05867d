"""Queries of mutations and sinks (SNK-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.functions import text as T
from watchplan.operators import mutations as O
from watchplan.plans import views as V


@query("snk02_insert_if_missing", "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(spark, d):
    new = V.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return O.missing(new, V.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), ["id"])


@query("snk03_upsert", """WITH a AS (SELECT user_id AS id, ts, event_id, value AS confidence, CASE WHEN event_id % 3 = 0 THEN event_type END AS label FROM events),
    l AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS n FROM a WHERE label IS NOT NULL)
    SELECT g.id, g.confidence, l.label, g.versions FROM (SELECT id, max(confidence) AS confidence, count(*) AS versions FROM a GROUP BY 1) g LEFT JOIN l ON l.id = g.id AND l.n = 1""")
def _(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.col("value").alias("confidence"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("label"))
    return O.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["id"], ["ts", "event_id"], ["confidence"], ["label"]).select("id", "confidence", "label", "versions")


@query("snk04_counters", "SELECT user_id, event_type, count(*) AS detection_count FROM events GROUP BY 1, 2")
def _(spark, d):
    return V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("detection_count"))


@query("snk05_expiry", "SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR THEN 'lost' ELSE 'active' END AS state FROM events GROUP BY 1")
def _(spark, d):
    last = V.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.select("user_id", O.expired(last, "seen", F.lit("2024-01-31").cast("timestamp_ntz"), "12 HOURS").alias("state"))


@query("snk06_requeue", "SELECT case_id, seq, price, CASE WHEN decision IS NULL AND seq < 3 THEN 'queued' WHEN decision IS NULL THEN 'dead' ELSE 'done' END AS status FROM results")
def _(spark, d):
    status = F.when(F.col("decision").isNull(), "failed").otherwise("done")
    return V.results(spark, d).select("case_id", "seq", "price", O.requeued(status, F.col("seq"), 3).alias("status"))


@query("snk07_claim", "SELECT id, CAST((n - 1) % 4 AS INTEGER) AS worker FROM (SELECT id, row_number() OVER (ORDER BY CASE priority WHEN '1-URGENT' THEN 0 ELSE 1 END, start_ts, id) AS n FROM cases WHERE status = 'open') WHERE n <= 40")
def _(spark, d):
    jobs = V.cases(spark, d).where("status = 'open'")
    return O.claimed(jobs, [F.when(F.col("priority") == "1-URGENT", 0).otherwise(1).asc(), F.col("start_ts").asc(), F.col("id").asc()], 4, 10).select("id", "worker")


@query("snk08_prune", "SELECT event_id FROM (SELECT event_id, event_type = 'purchase' AS kept, row_number() OVER (PARTITION BY user_id, event_type <> 'purchase' ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE kept OR n <= 10")
def _(spark, d):
    return O.pruned(V.table(spark, d, "events"), ["user_id"], F.col("event_type") != "purchase", [F.desc("ts"), F.desc("event_id")], 10).select("event_id")


@query("snk09_insert_select", "SELECT id, coalesce(name, 'Person ' || id) AS name, CASE WHEN employee_name IS NULL THEN 'enrolled from an unknown face' ELSE 'employee' END AS note FROM people WHERE visitor_name IS NULL")
def _(spark, d):
    return V.people(spark, d).where("visitor_name is null").select("id", F.coalesce("name", F.format_string("Person %d", "id")).alias("name"), F.when(F.col("employee_name").isNull(), "enrolled from an unknown face").otherwise("employee").alias("note"))


@query("snk15_object_key", "SELECT id, 'faces/cam_' || camera_id || '/' || id || '.jpg' AS key FROM logs")
def _(spark, d):
    return V.logs(spark, d).select("id", T.object_key(F.col("camera_id"), F.col("id"), "jpg").alias("key"))


@query("snk16_incremental_sync", "SELECT page_id AS key, md5(html) AS tag FROM pages WHERE page_id % 3 <> 0 OR page_id % 5 = 0")
def _(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("key"), F.md5(F.col("html").cast("binary")).alias("tag"))
    old = p.where("key % 3 = 0").withColumn("tag", F.when(F.col("key") % 5 == 0, "older").otherwise(F.col("tag")))
    return O.to_sync(p, old, "key", "tag")


@query("snk17_sanitised", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events")
def _(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return V.table(spark, d, "events").select("event_id", T.finite(odd).alias("value"))


@query("snk01_returned_ids", "SELECT event_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id) AS id FROM events WHERE event_type = 'error'")
def _(spark, d):
    new = V.table(spark, d, "events").where("event_type = 'error'").select("event_id")
    return O.inserted(V.cases(spark, d).select("id"), new, "id", "event_id").select("event_id", "id")


@query("snk11_session_heartbeat", """WITH b AS (SELECT user_id % 25 AS camera_id, ts, event_id, event_type AS name, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT user_id % 25, ts, event_id, 'last_event', CAST(event_id AS VARCHAR) FROM events)
    SELECT camera_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, name ORDER BY ts DESC, event_id DESC) AS n FROM b) WHERE n = 1""")
def _(spark, d):
    e = V.table(spark, d, "events").withColumn("fields", F.create_map(F.col("event_type"), F.get_json_object("props", "$.k"), F.lit("last_event"), F.col("event_id").cast("string")))
    return O.heartbeats(e.withColumn("camera_id", F.col("user_id") % 25), ["camera_id"], ["ts", "event_id"], "fields").select("camera_id", "name", "value")


@query("snk12_rules", """WITH c AS (SELECT id, 'deactivate' AS op, 1 AS tm FROM rules WHERE id % 4 = 0 UNION ALL SELECT id, 'reactivate', 4 FROM rules WHERE id % 8 = 0 UNION ALL SELECT id, 'delete', 2 + id % 3 FROM rules WHERE id % 9 = 0 UNION ALL SELECT id + 1000000000, 'delete', 1 FROM rules WHERE id % 5 = 0),
    l AS (SELECT id, arg_max(op, tm) AS op, bool_or(op = 'delete') AS gone FROM c GROUP BY 1), k AS (SELECT r.id, r.text, coalesce(l.op <> 'deactivate', true) AS active FROM rules r LEFT JOIN l ON l.id = r.id WHERE NOT coalesce(l.gone, false))
    SELECT * FROM k UNION ALL SELECT (SELECT max(id) FROM rules) + row_number() OVER (ORDER BY s_suppkey), s_name, true FROM supplier""")
def _(spark, d):
    base = V.rules(spark, d)
    rules, k = base.select("id", "text", F.lit(True).alias("active")), F.col("id")
    said = [(k % 4 == 0, k, "deactivate", F.lit(1)), (k % 8 == 0, k, "reactivate", F.lit(4)), (k % 9 == 0, k, "delete", 2 + k % 3), (k % 5 == 0, k + 1_000_000_000, "delete", F.lit(1))]
    changes = reduce(lambda a, b: a.unionByName(b), (base.where(where).select(i.alias("id"), F.lit(op).alias("op"), at.cast("int").alias("at")) for where, i, op, at in said))
    new = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("text"), F.lit(True).alias("active"))
    return O.rules_changed(rules, changes).unionByName(O.inserted(rules, new, "id", "n").select("id", "text", "active"))
