"""Two-stage identity search, galleries that grow, and nearest neighbours through inverted lists, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchplan.operators import inverted as I
from watchplan.operators import matching as O
from watchplan.sources.shared import folder


def frame(spark, rows, schema="vec_id long, v array<double>, label long, own boolean"):
    return spark.createDataFrame(rows, schema).repartition(3)


def decided(spark, rows, query, **settings):
    g = frame(spark, rows)
    q = g.where(F.col("vec_id") == query)
    found = O.identities(O.nearest(q, g, 3, first="own"), g.select(F.col("vec_id").alias("other_id"), "label"))
    found = found.withColumn("first", F.lit(any(r[3] and r[0] != query for r in rows))).withColumn("quality", F.lit(settings.pop("quality", None)).cast("double"))
    got = O.decision(found, 0.5, 0.05, 0.55, O.stage_identities(g, "own")).select("label", "second", "first", "decision").collect()
    return got[0] if got else None


def test_authoritative_vectors_come_first(spark):
    rows = [(1, [1.0, 0.0], 9, False), (2, [0.9, 0.1], 7, True), (3, [0.0, 1.0], 8, True), (4, [1.0, 0.01], 9, False)]
    assert decided(spark, rows, 1)[:] == (7, 8, True, "match")  # 4 is nearer, but isn't authoritative
    only_own = [(i, v, label, False) for i, v, label, _ in rows]
    assert decided(spark, only_own, 1)[:] == (9, 7, False, "unknown")  # too small a margin
    # the query's own vector is the only authoritative one: its first stage is empty
    alone = [(i, v, label, i == 1) for i, v, label, _ in rows]
    assert decided(spark, alone, 1)["label"] == 9


def test_a_second_identity_is_required_where_there_are_two(spark):
    near = [(k, [1.0, k / 1000], 7, False) for k in range(1, 6)]
    assert decided(spark, near, 1)[:] == (7, None, False, "match")  # one identity in all
    assert decided(spark, [*near, (9, [0.0, 1.0], 8, False)], 1)[:] == (7, None, False, "unknown")  # beyond the three nearest
    assert decided(spark, near, 1, quality=0.5)["decision"] == "unknown"
    assert decided(spark, near, 1, quality=0.55)["decision"] == "match"


def at_angle(degrees):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]


def learn(spark, rows, learner):
    df = spark.createDataFrame([(5, i, float(at), at_angle(a), own, may) for i, at, a, own, may in rows], "label long, vec_id long, at double, v array<double>, authoritative boolean, allowed boolean").repartition(4)
    return [(r.vec_id, r.outcome, r.pruned) for r in O.learned(df, learner).orderBy("vec_id").collect()]


def test_what_an_identity_learns(spark):
    rows = [
        (1, 0, 0, False, True), (2, 1, 0, True, True), (3, 2, 60, False, True), (4, 3, 20, False, True), (5, 50, 30, False, True), (6, 64, 21, False, True), (7, 64, 40, False, False), (8, 64, 40, False, True), (9, 200, 44, False, True),
    ]
    # 3 is too unlike; 4 is learned; 5 comes too soon; 6 is like the learned 4, not like 2; 7 isn't allowed; 8 is learned; 9 is like 2 only through 0.707
    assert learn(spark, rows, O.Learner(0.71, 60, 0.99, 100)) == [
        (1, "unknown", []), (2, "enrolled", []), (3, "refused", []), (4, "learned", []), (5, "cooldown", []), (6, "duplicate", []), (7, "refused", []), (8, "learned", []), (9, "duplicate", []),
    ]


def test_the_oldest_learned_is_pruned_and_may_come_again(spark):
    rows = [(1, 0, 0, True, True), (2, 10, 20, False, True), (3, 20, 30, False, True), (4, 30, 40, False, True), (5, 40, 21, False, True), (6, 50, 31, False, True)]
    got = learn(spark, rows, O.Learner(0.5, 0, 0.99, 3))
    # 4 pushes 2 out, so 5, like 2, is new again and pushes 3 out, so 6 is new too
    assert got == [(1, "enrolled", []), (2, "learned", []), (3, "learned", []), (4, "learned", [2]), (5, "learned", [3]), (6, "learned", [4])]


def test_at_the_cap_of_authoritative_vectors_nothing_new_stays(spark):
    rows = [(1, 0, 0, True, True), (2, 0, 50, True, True), (3, 10, 20, False, True), (4, 20, 20, False, True)]
    assert learn(spark, rows, O.Learner(0.5, 0, 0.99, 2))[2:] == [(3, "learned", [3]), (4, "learned", [4])]


def test_learning_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, 0.0, [1.0], True, True), (1, 2, 0.0, None, True, True), (1, 3, 0.0, [0.0], None, None), (1, 4, 1.0, [0.0], True, True), (1, 5, 2.0, [1.0], None, True)], "label long, vec_id long, at double, v array<double>, authoritative boolean, allowed boolean")
    assert [(r.vec_id, r.outcome, r.similarity) for r in O.learned(df, O.Learner()).orderBy("vec_id").collect()] == [(3, "unknown", None), (4, "enrolled", None), (5, "refused", 0.0)]
    assert O.learned(df.where("false"), O.Learner()).collect() == []


@pytest.fixture(scope="module")
def gallery(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_lists_are_exact_and_near_enough(spark, gallery, metric):
    q, place = gallery.where("vec_id % 50 = 0"), folder(spark)
    truth = O.nearest(q, gallery, 10, metric)
    index = I.build(gallery, place, metric=metric)
    key = ["query_id", "other_id", "rank"]
    assert sorted(truth.select(*key).collect()) == sorted(I.search(q, index, 10, place, exact=True).select(*key).collect())
    assert index.blocks.agg(F.sum(F.size("ids"))).first()[0] == gallery.count()  # every row is in the index
    probes = I.probes_for(gallery.where("vec_id % 50 = 25"), index, 10, place, 0.9)  # other queries
    share = I.recall(I.search(q, index, 10, place, probes), truth).agg(F.avg("recall")).first()[0]
    assert share >= 0.9


def test_clear_clusters_need_few_probes(spark):
    rng = np.random.default_rng(6)
    heart = rng.normal(size=(30, 16)) * 5
    g = spark.createDataFrame([(k, (heart[k % 30] + rng.normal(size=16)).tolist()) for k in range(3000)], "vec_id long, v array<double>")
    q, place = g.where("vec_id % 50 = 0"), folder(spark)
    index = I.build(g, place, 30, metric="euclidean")
    truth = O.nearest(q, g, 10, "euclidean")
    assert I.recall(I.search(q, index, 10, place, 4), truth).agg(F.avg("recall")).first()[0] >= 0.97


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_lists_with_a_hot_list_zeros_and_few_rows(spark, metric):
    rng = np.random.default_rng(4)
    rows = [(k, [1.0, 1.0, 0.0]) for k in range(5000)] + [(9000 + k, rng.normal(size=3).round(2).tolist()) for k in range(300)] + [(20_000, [0.0] * 3), (20_001, [0.0] * 3), (20_002, None)]
    g = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    q, place = g.where("vec_id IN (3, 9001, 9050, 20000, 20002)"), folder(spark)
    index = I.build(g, place, metric=metric)
    assert index.blocks.agg(F.max(F.size("ids"))).first()[0] <= I.BLOCK < 5000
    some = g.where("v IS NOT NULL")
    key = ["query_id", "other_id", "rank"]
    assert sorted(O.nearest(q.where("v IS NOT NULL"), some, 7, metric).select(*key).collect()) == sorted(I.search(q, index, 7, place, probes=2, exact=True).select(*key).collect())
    few = g.where("vec_id IN (3, 9001)")
    index = I.build(few, folder(spark), metric=metric)
    assert I.search(few, index, 5, place, exact=True).count() == 2
    none = I.build(g.where("false"), folder(spark), metric=metric)
    assert I.search(q, none, 5, folder(spark), exact=True).collect() == []
