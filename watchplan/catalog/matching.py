"""Queries of vector matching (J-11, M-1..M-3, A-23, T-5, R-1, R-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchplan.catalog.registry import query
from watchplan.operators import inverted as I
from watchplan.operators import matching as O
from watchplan.plans import views as V
from watchplan.sources.shared import bound_batches, folder

#: The stated set of queries, which meets all other vectors.
_Q = "vec_id % 50 = 0"
_SIM = "round(list_cosine_similarity(q.v, g.v), 12)"


_PAIRS = f"FROM vectors q, vectors g WHERE q.{_Q} AND g.vec_id <> q.vec_id"


def _parts(spark, d):
    bound_batches(spark)  # a pair of blocks is megabytes
    v = V.vectors(spark, d)
    return v.where(_Q), v


@query("j11_similar_to_one", f"SELECT g.vec_id, round(list_cosine_similarity(q.v, g.v), 6) AS similarity FROM vectors g, (SELECT v FROM vectors WHERE vec_id = 7) q WHERE g.vec_id <> 7 ORDER BY {_SIM} DESC, g.vec_id LIMIT 50")
def _(spark, d):
    v = V.vectors(spark, d)
    one = v.where("vec_id = 7").select(F.col("v").alias("q"))
    rows = v.where("vec_id <> 7").crossJoin(F.broadcast(one)).withColumn("s", O.cosine(F.col("q"), F.col("v")))  # one row
    return rows.orderBy(F.round("s", 12).desc(), "vec_id").limit(50).select("vec_id", F.round("s", 6).alias("similarity"))


@query("m01_l2_normalised", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x) / sqrt(list_dot_product(v, v)))), 8) AS l1 FROM vectors")
def _(spark, d):
    unit = O.normalised(F.col("v"))
    return V.vectors(spark, d).select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + F.abs(x)), 8).alias("l1"))


@query("m02_cosine_top_k", f"SELECT query_id, other_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, g.vec_id AS other_id, {_SIM} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, g.vec_id) AS rank {_PAIRS}) WHERE rank <= 10")
def _(spark, d):
    return _top_k(*_parts(spark, d))


def _top_k(q, g):
    return O.nearest(q, g, 10).select("query_id", "other_id", F.round("value", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("m03_knn_mean_distance", f"SELECT query_id, round(avg(s) FILTER (WHERE rank <= 1), 6) AS knn_1, round(avg(s) FILTER (WHERE rank <= 5), 6) AS knn_5, round(avg(s), 6) AS knn_10 FROM (SELECT q.vec_id AS query_id, list_distance(q.v, g.v) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, g.v), 12), g.vec_id) AS rank {_PAIRS}) WHERE rank <= 10 GROUP BY 1")
def _(spark, d):
    return _knn(*_parts(spark, d))


def _knn(q, g):
    m = O.mean_distance(O.nearest(q, g, 10, "euclidean"), [1, 5, 10])
    return m.select("query_id", *(F.round(f"knn_{k}", 6).alias(f"knn_{k}") for k in (1, 5, 10)))


_TOP = f"""WITH top AS (SELECT query_id, label, max(s) AS best FROM (SELECT q.vec_id AS query_id, g.label, list_cosine_similarity(q.v, g.v) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, g.vec_id) AS rank {_PAIRS}) WHERE rank <= 50 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, label) AS n FROM top),
    two AS (SELECT query_id, max(label) FILTER (WHERE n = 1) AS label, max(best) FILTER (WHERE n = 1) AS similarity, max(label) FILTER (WHERE n = 2) AS second, max(best) FILTER (WHERE n = 1) - max(best) FILTER (WHERE n = 2) AS margin FROM r GROUP BY 1)"""


def _two(q, g):
    return O.identities(O.nearest(q, g, 50), g.select(F.col("vec_id").alias("other_id"), "label"))


@query("a23_identity_margin", _TOP + " SELECT query_id, label, round(similarity, 6) AS similarity, second, round(margin, 6) AS margin FROM two")
def _(spark, d):
    return _margin(_two(*_parts(spark, d)))


def _margin(two):
    return two.select("query_id", "label", F.round("similarity", 6).alias("similarity"), "second", F.round("margin", 6).alias("margin"))


#: Authoritative vectors, and a query's quality: null for one in seven.
_OWN = "vec_id % 3 = 1"
_QUALITY = "CASE WHEN vec_id % 7 <> 0 THEN vec_id % 41 / 40 END"


@query("r01_identity_decision", f"""WITH every AS (SELECT q.vec_id AS query_id, g.vec_id AS other_id, g.label, g.{_OWN} AS own, list_cosine_similarity(q.v, g.v) AS s {_PAIRS}),
    staged AS (SELECT *, bool_or(own) OVER (PARTITION BY query_id) AS first FROM every),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, other_id) AS rank FROM staged WHERE own OR NOT first),
    ids AS (SELECT query_id, first, label, max(s) AS best FROM near WHERE rank <= 50 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, label) AS n FROM ids),
    two AS (SELECT query_id, bool_or(first) AS first, max(label) FILTER (WHERE n = 1) AS label, max(best) FILTER (WHERE n = 1) AS similarity, max(best) FILTER (WHERE n = 2) AS second FROM r GROUP BY 1),
    space AS (SELECT count(DISTINCT label) FILTER (WHERE {_OWN}) AS own, count(DISTINCT label) AS every FROM vectors)
    SELECT query_id, label, first, CASE WHEN similarity >= 0.30 AND coalesce(similarity - second >= 0.03, true) AND coalesce({_QUALITY.replace("vec_id", "query_id")} >= 0.25, true)
        AND (second IS NOT NULL OR CASE WHEN first THEN space.own ELSE space.every END < 2) THEN 'match' ELSE 'unknown' END AS decision FROM two, space""")
def _(spark, d):
    q, g = _parts(spark, d)
    g = g.withColumn("own", F.expr(_OWN))
    near = O.nearest(q, g, 50, first="own")
    stage = near.select("query_id", "first").distinct()
    found = O.identities(near, g.select(F.col("vec_id").alias("other_id"), "label")).join(stage, "query_id").withColumn("quality", F.expr(_QUALITY.replace("vec_id", "query_id")))
    return O.decision(found, 0.30, 0.03, 0.25, O.stage_identities(g, "own")).select("query_id", "label", "first", "decision")


@query("r02_auto_learn", f"""WITH RECURSIVE h AS (SELECT label, vec_id, vec_id * 20.0 AS tm, v, vec_id % 6 = 1 AS own, coalesce({_QUALITY} >= 0.25, true) AS allowed, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM vectors WHERE label IS NOT NULL),
    e AS (SELECT h.label, h.vec_id, h.n, h.tm, s.last, s.held, h.v, h.own, h.allowed, NULL::VARCHAR AS outcome, NULL::DOUBLE AS similarity, NULL::DOUBLE AS nearest, NULL::BIGINT[] AS pruned
          FROM (SELECT label, 0 AS n, NULL::DOUBLE AS last, []::STRUCT(id BIGINT, v DOUBLE[], own BOOLEAN)[] AS held FROM h GROUP BY label) s JOIN h ON h.label = s.label AND h.n = 0 WHERE false
          UNION ALL SELECT label, NULL, 0, NULL, NULL, []::STRUCT(id BIGINT, v DOUBLE[], own BOOLEAN)[], NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM h GROUP BY label
          UNION ALL SELECT label, vec_id, n, tm, CASE WHEN outcome = 'learned' THEN tm ELSE last END,
              CASE WHEN outcome = 'enrolled' THEN next WHEN outcome = 'learned' THEN list_filter(next, lambda x: NOT list_contains(gone, x.id)) ELSE held END, v, own, allowed, outcome, similarity, nearest, CASE WHEN outcome = 'learned' THEN gone ELSE [] END
          FROM (SELECT *, list_slice(list_transform(list_filter(next, lambda x: NOT x.own), lambda x: x.id), 1, greatest(0, len(next) - 25)) AS gone,
                CASE WHEN own THEN 'enrolled' WHEN len(held) = 0 THEN 'unknown' WHEN NOT allowed OR similarity < 0.2 THEN 'refused' WHEN tm - last < 900 THEN 'cooldown' WHEN nearest >= 0.35 THEN 'duplicate' ELSE 'learned' END AS outcome
                FROM (SELECT *, CASE WHEN NOT own THEN list_max(sims) END AS nearest, CASE WHEN NOT own THEN coalesce(list_max(own_sims), list_max(sims)) END AS similarity
                      FROM (SELECT h.label, h.vec_id, h.n, h.tm, e.last, e.held, h.v, h.own, h.allowed, list_append(e.held, {{'id': h.vec_id, 'v': h.v, 'own': h.own}}) AS next,
                            list_transform(e.held, lambda x: list_cosine_similarity(x.v, h.v)) AS sims, list_transform(list_filter(e.held, lambda x: x.own), lambda x: list_cosine_similarity(x.v, h.v)) AS own_sims
                            FROM e JOIN h ON h.label = e.label AND h.n = e.n + 1))))
    SELECT label, vec_id, outcome, round(similarity, 6) AS similarity, round(nearest, 6) AS nearest, pruned FROM e WHERE n > 0""")
def _(spark, d):
    rows = V.vectors(spark, d).select("label", "vec_id", "v", (F.col("vec_id") * 20.0).alias("at"), F.expr("vec_id % 6 = 1").alias("authoritative"), F.expr(f"coalesce({_QUALITY} >= 0.25, true)").alias("allowed"))
    out = O.learned(rows, O.Learner(0.2, 900.0, 0.35, 25))
    return out.select("label", "vec_id", "outcome", F.round("similarity", 6).alias("similarity"), F.round("nearest", 6).alias("nearest"), "pruned")


@query("t05_vector_top_k_of_many", f"SELECT query_id, other_id FROM (SELECT q.vec_id AS query_id, g.vec_id AS other_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, g.vec_id) AS rank FROM vectors q, vectors g WHERE q.{_Q} AND g.vec_id <> q.vec_id) WHERE rank <= 3")
def _(spark, d):
    return O.nearest(*_parts(spark, d), 3).select("query_id", "other_id")


_EXACT = f"SELECT query_id, other_id, round(s, 6) AS {{value}}, rank FROM (SELECT q.vec_id AS query_id, g.vec_id AS other_id, {{s}} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({{s}}, 12) {{way}}, g.vec_id) AS rank {_PAIRS}) WHERE rank <= 10"


@query("t05b_top_k_through_lists", _EXACT.format(value="similarity", s="list_cosine_similarity(q.v, g.v)", way="DESC"))
def _(spark, d):
    q, g = _parts(spark, d)
    place = folder(spark)
    return I.search(q, I.build(g, place), 10, place, exact=True).select("query_id", "other_id", F.round("value", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("m03b_neighbours_through_lists", _EXACT.format(value="distance", s="list_distance(q.v, g.v)", way=""))
def _(spark, d):
    q, g = _parts(spark, d)
    place = folder(spark)
    return I.search(q, I.build(g, place, metric="euclidean"), 10, place, exact=True).select("query_id", "other_id", F.round("value", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))
