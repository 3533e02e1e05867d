"""The surveillance model as views of the driver's tables, in DataFrames and in SQL.

logs: recognitions; people, cameras: dimensions; cases, results: anomaly cases and their reasoning
results; scores: a track's scores in time order; vectors: face vectors by identity.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    known, k = F.col("event_type") != "error", F.col("k")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.when(known, F.col("user_id")).alias("detected_id"), (F.col("user_id") % 25).alias("camera_id"),
        F.when(k % 3 != 0, k % 2 == 0).alias("authorized"), F.when(known, k / 100).alias("similarity"), F.when(known, (k % 40) / 100).alias("margin"),
        F.when(k % 10 != 0, F.col("value") / 500).alias("quality"), (k * 10).alias("processing_ms"), "event_type", "value", "user_id", "k",
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 3 == 0, F.col("c_name")).alias("employee_name"), F.when(key % 3 == 1, F.col("c_name")).alias("visitor_name"),
        F.when(key % 5 != 0, F.concat(F.lit("Person "), key.cast("string"))).alias("name"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(key.alias("id"), F.when(key % 7 != 0, F.col("n_name")).alias("name"), F.col("n_regionkey").cast("long").alias("site"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("reviewing")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), (F.col("o_custkey") % 25).alias("camera_id"), F.col("o_custkey").alias("track_id"), status.alias("status"), severity.alias("severity"),
        F.col("o_orderdate").alias("start_ts"), F.when(key % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("peak_ts"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("priority"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, part = F.col("l_returnflag"), F.col("l_partkey") % 3
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.when(flag == "A", "YES").when(flag == "R", "NO").when(F.col("l_partkey") % 11 != 0, "UNCERTAIN").alias("decision"), F.when(F.col("l_linestatus") == "O", "HIGH").otherwise("low").alias("severity"),
        F.when(part == 0, "pose").when(part == 1, "deep").otherwise("homography_macro").alias("gate"), (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_quantity").alias("score"), F.when(F.col("l_suppkey") % 9 != 0, 18 + F.col("l_linenumber")).otherwise(0).cast("double").alias("threshold"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.col("value").alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


#: Kinds, events and gates of rules.
RULE_TYPES = ["trigger", "suppress", "Alert", " ignore ", "other", "detection", "benign", "TRIGGER_RULE", "trigger", "context"]
RULE_EVENTS = ["loitering", "running", "fighting", "other", "intrusion", "theft", "weapon"]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part: its place is the brand, now and then everywhere; texts repeat."""
    key, pick = F.col("p_partkey"), lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    place = F.when(key % 499 == 0, "All").when(key % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), pick(RULE_TYPES, key).alias("rule_type"), pick(RULE_EVENTS, F.col("p_size")).alias("event"), place.alias("place"), F.when(key % 4 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  "))).alias("text"),
        F.when(key % 2 == 0, "pose,deep").when(key % 3 == 0, "deep").otherwise("pose,homography").alias("gates"), F.when(key % 4 > 0, 1 + (key % 20) / 20).alias("min_ratio"), F.when(key % 5 > 0, 2 + (key % 30) / 20).alias("max_ratio"), (key % 3 == 1).alias("needs_evidence"),
    )


#: The same in SQL.
VIEWS = {
    "logs": """SELECT event_id AS id, ts, CASE WHEN event_type <> 'error' THEN user_id END AS detected_id, user_id % 25 AS camera_id,
        CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS authorized, CASE WHEN event_type <> 'error' THEN k / 100 END AS similarity,
        CASE WHEN event_type <> 'error' THEN (k % 40) / 100 END AS margin, CASE WHEN k % 10 <> 0 THEN value / 500 END AS quality,
        k * 10 AS processing_ms, event_type, value, user_id, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "people": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS employee_name, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS visitor_name,
        CASE WHEN c_custkey % 5 <> 0 THEN 'Person ' || c_custkey END AS name FROM customer""",
    "cameras": "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS name, CAST(n_regionkey AS BIGINT) AS site FROM nation",
    "cases": """SELECT o_orderkey AS id, o_custkey % 25 AS camera_id, o_custkey AS track_id,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'reviewing' END AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
        o_orderdate AS start_ts, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 2 DAY END AS peak_ts, o_totalprice AS score, o_orderpriority AS priority FROM orders""",
    "results": """SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS part, l_suppkey AS supp,
        CASE WHEN l_returnflag = 'A' THEN 'YES' WHEN l_returnflag = 'R' THEN 'NO' WHEN l_partkey % 11 <> 0 THEN 'UNCERTAIN' END AS decision,
        CASE WHEN l_linestatus = 'O' THEN 'HIGH' ELSE 'low' END AS severity,
        CASE l_partkey % 3 WHEN 0 THEN 'pose' WHEN 1 THEN 'deep' ELSE 'homography_macro' END AS gate, l_discount * 10 AS confidence,
        l_quantity AS score, CAST(CASE WHEN l_suppkey % 9 <> 0 THEN 18 + l_linenumber ELSE 0 END AS DOUBLE) AS threshold, l_shipdate AS ts, l_extendedprice AS price FROM lineitem""",
    "rules": f"""SELECT p_partkey AS id, ({RULE_TYPES!r})[p_partkey % {len(RULE_TYPES)} + 1] AS rule_type, ({RULE_EVENTS!r})[p_size % {len(RULE_EVENTS)} + 1] AS event, CASE WHEN p_partkey % 499 = 0 THEN 'All' WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS place,
        CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '  ') END AS text, CASE WHEN p_partkey % 2 = 0 THEN 'pose,deep' WHEN p_partkey % 3 = 0 THEN 'deep' ELSE 'pose,homography' END AS gates,
        CASE WHEN p_partkey % 4 > 0 THEN 1 + (p_partkey % 20) / 20 END AS min_ratio, CASE WHEN p_partkey % 5 > 0 THEN 2 + (p_partkey % 30) / 20 END AS max_ratio, p_partkey % 3 = 1 AS needs_evidence FROM part""",
    "scores": "SELECT event_id, user_id, event_type, ts, value AS score FROM events",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings",
}


def with_views(sql: str) -> str:
    """sql preceded by the views that it names."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if re.search(rf"\b{name}\b", sql) and not re.search(rf"\b{name} AS \(", sql)]
    if not used:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + sql[len("WITH RECURSIVE") :]
    return "WITH " + ", ".join(used) + (", " + sql[4:] if sql.upper().startswith("WITH") else " " + sql)
