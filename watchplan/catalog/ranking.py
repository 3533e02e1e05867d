"""Queries of sorts, limits, sets and sampling (T-*, U-*, P-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.operators import ranking as O
from watchplan.plans import views as V


@query("t01_page", "SELECT id, ts FROM logs ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 50")
def _(spark, d):
    return O.page(V.logs(spark, d).select("id", "ts"), [F.desc("ts"), F.desc("id")], 50, 25)


@query("t02_nulls_last", "SELECT id, quality FROM logs ORDER BY quality DESC NULLS LAST, id DESC LIMIT 40")
def _(spark, d):
    return V.logs(spark, d).select("id", "quality").orderBy(F.desc_nulls_last("quality"), F.desc("id")).limit(40)


@query("t03_case_ranked", "SELECT id, priority FROM cases ORDER BY CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, start_ts, id LIMIT 30")
def _(spark, d):
    return V.cases(spark, d).orderBy(O.rank_of(F.col("priority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]), "start_ts", "id").limit(30).select("id", "priority")


@query("t04_composite_priority", "SELECT case_id, seq, price FROM results ORDER BY CASE decision WHEN 'YES' THEN 0 WHEN 'UNCERTAIN' THEN 1 WHEN 'NO' THEN 2 ELSE 3 END, CASE upper(severity) WHEN 'HIGH' THEN 0 ELSE 1 END, -CASE WHEN threshold > 0 THEN score / threshold ELSE 0 END, ts, price LIMIT 25")
def _(spark, d):
    ratio = F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold")).otherwise(0.0)
    return V.results(spark, d).orderBy(O.rank_of(F.col("decision"), ["YES", "UNCERTAIN", "NO"]), O.rank_of(F.upper("severity"), ["HIGH"]), -ratio, "ts", "price").limit(25).select("case_id", "seq", "price")


@query("t06_unread_first", "SELECT id FROM logs ORDER BY (authorized IS NOT NULL), ts DESC, id LIMIT 10")
def _(spark, d):
    return V.logs(spark, d).orderBy(F.col("authorized").isNotNull(), F.desc("ts"), "id").limit(10).select("id")


@query("t07_page_with_total", "SELECT id, (SELECT count(*) FROM cases WHERE status = 'open') AS total FROM cases WHERE status = 'open' ORDER BY start_ts DESC, id LIMIT 20")
def _(spark, d):
    rows = V.cases(spark, d).where("status = 'open'")
    return O.page(rows, [F.desc("start_ts"), F.asc("id")], 0, 20).select("id").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("t08_page_count", "SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM logs")
def _(spark, d):
    return V.logs(spark, d).agg(F.ceil(F.count(F.lit(1)) / 25).cast("long").alias("pages"))


@query("t09_top_outliers", "SELECT event_id, score FROM scores ORDER BY score DESC, event_id LIMIT 15")
def _(spark, d):
    return V.scores(spark, d).orderBy(F.desc("score"), "event_id").limit(15).select("event_id", "score")


@query("t10_peaks", """WITH RECURSIVE h AS (SELECT user_id, event_type, score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id, score) - 1 AS i FROM scores),
    c AS (SELECT user_id, event_type, i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, i DESC) AS n FROM h WHERE score > 60),
    r AS (SELECT user_id, event_type, n, [i] AS peaks FROM c WHERE n = 1 UNION ALL
          SELECT c.user_id, c.event_type, c.n, CASE WHEN len(r.peaks) < 4 AND len(list_filter(r.peaks, lambda p: abs(p - c.i) <= 1)) = 0 THEN list_append(r.peaks, c.i) ELSE r.peaks END FROM r JOIN c ON c.user_id = r.user_id AND c.event_type = r.event_type AND c.n = r.n + 1),
    l AS (SELECT user_id, event_type, arg_max(peaks, n) AS peaks FROM r GROUP BY 1, 2)
    SELECT t.user_id, t.event_type, coalesce(l.peaks, []) AS peaks FROM (SELECT DISTINCT user_id, event_type FROM scores) t LEFT JOIN l ON l.user_id = t.user_id AND l.event_type = t.event_type""")
def _(spark, d):
    return O.track_peaks(V.scores(spark, d), ["user_id", "event_type"], ["ts", "event_id", "score"], F.col("score") - 60, 4, "user_id long, event_type string")


@query("t11_best_model", "SELECT event_type, k, bic FROM (SELECT event_type, user_id % 7 AS k, round(avg(score), 9) AS bic, row_number() OVER (PARTITION BY event_type ORDER BY avg(score), user_id % 7) AS n FROM scores GROUP BY 1, 2) WHERE n = 1")
def _(spark, d):
    m = V.scores(spark, d).groupBy("event_type", (F.col("user_id") % 7).alias("k")).agg(F.avg("score").alias("bic"))
    best = m.groupBy("event_type").agg(F.min(F.struct("bic", "k")).alias("b"))
    return best.select("event_type", "b.k", F.round("b.bic", 9).alias("bic"))


@query("t12_even_sample", "SELECT user_id, list_transform(range(5), lambda i: ids[CAST(round_even(i * (len(ids) - 1) / 4.0::DOUBLE, 0) AS BIGINT) + 1]) AS keys FROM (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1) WHERE len(ids) > 5")
def _(spark, d):
    return O.even_samples(V.table(spark, d, "events"), "user_id", "event_id", 5)


@query("u01_bag_union", "SELECT * FROM ((SELECT 'employee' AS kind, employee_name AS name FROM people WHERE employee_name IS NOT NULL ORDER BY 2 LIMIT 20) UNION ALL (SELECT 'visitor', visitor_name FROM people WHERE visitor_name IS NOT NULL ORDER BY 2 LIMIT 20) UNION ALL (SELECT 'enrolled', name FROM people WHERE name IS NOT NULL ORDER BY 2 LIMIT 20))")
def _(spark, d):
    from functools import reduce

    p = V.people(spark, d)
    part = lambda kind, c: p.where(F.col(c).isNotNull()).orderBy(c).limit(20).select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return reduce(lambda a, b: a.unionByName(b), [part("employee", "employee_name"), part("visitor", "visitor_name"), part("enrolled", "name")])


@query("u02_two_timelines", "SELECT 'event' AS kind, id, CAST(ts AS TIMESTAMP) AS ts, value AS ratio FROM logs WHERE event_type = 'error' UNION ALL SELECT 'case', id, CAST(start_ts AS TIMESTAMP), score FROM cases WHERE severity = 'critical'")
def _(spark, d):
    a = V.logs(spark, d).where("event_type = 'error'").select(F.lit("event").alias("kind"), "id", "ts", F.col("value").alias("ratio"))
    return a.unionByName(V.cases(spark, d).where("severity = 'critical'").select(F.lit("case").alias("kind"), "id", F.col("start_ts").alias("ts"), F.col("score").alias("ratio")))


@query("u03_splits_together", """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY substr(md5('42|' || user_id), 1, 12), user_id) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT user_id FROM scores)),
    s AS (SELECT event_id, score, CASE WHEN n <= greatest(1, round_even(total * 0.7::DOUBLE, 0)) THEN 'train' WHEN n <= greatest(1, round_even(total * 0.7::DOUBLE, 0)) + greatest(1, round_even(total * 0.15::DOUBLE, 0)) THEN 'calibration' ELSE 'test' END AS split FROM scores JOIN g ON scores.user_id = g.user_id)
    SELECT event_id, split, CASE WHEN split = 'calibration' THEN score END AS fitted FROM s WHERE split <> 'train'""")
def _(spark, d):
    s = O.group_split(V.scores(spark, d), "user_id", (0.7, 0.15), 42)
    calibration = s.where("split = 'calibration'").select("event_id", "split", F.col("score").alias("fitted"))
    return calibration.unionByName(s.where("split = 'test'").select("event_id", "split"), allowMissingColumns=True)


@query("u04_token_overlap", "SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'and', 'der', 'die', 'que', 'les'])) AS shared FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    words = F.split(F.lower("text"), " ")
    return V.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "and", "der", "die", "que", "les"))))).cast("long").alias("shared"))


@query("u05_distinct_tracks", "SELECT count(*) AS tracks FROM (SELECT DISTINCT user_id, event_type FROM scores)")
def _(spark, d):
    return V.scores(spark, d).dropDuplicates(["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("tracks"))


@query("u06_filter_options", "SELECT DISTINCT coalesce(name, 'Unnamed') AS option FROM cameras ORDER BY 1")
def _(spark, d):
    return V.cameras(spark, d).select(F.coalesce("name", F.lit("Unnamed")).alias("option")).distinct().orderBy("option")


@query("p01_group_split", """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY substr(md5('42|' || user_id), 1, 12), user_id) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT user_id FROM scores))
    SELECT event_id, CASE WHEN n <= greatest(1, round_even(total * 0.7::DOUBLE, 0)) THEN 'train' WHEN n <= greatest(1, round_even(total * 0.7::DOUBLE, 0)) + greatest(1, round_even(total * 0.15::DOUBLE, 0)) THEN 'calibration' ELSE 'test' END AS split FROM scores JOIN g ON scores.user_id = g.user_id""")
def _(spark, d):
    return O.group_split(V.scores(spark, d), "user_id", (0.7, 0.15), 42).select("event_id", "split")


@query("p02_enough_of_each", "SELECT vec_id, label FROM (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM vectors) WHERE n >= 48 AND r <= 5")
def _(spark, d):
    return O.enough_of_each(V.vectors(spark, d).select("vec_id", "label"), "label", 48, 5, ["vec_id"])
