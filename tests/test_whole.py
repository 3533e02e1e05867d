"""Queries over whole tables: every row, vector and component takes part."""

import json
import math

import pytest

from watchplan import catalog

Q = catalog.QUERIES


@pytest.mark.parametrize("name,table", [("j05_evidence_media", "lineitem"), ("r10_split_evidence", "lineitem"), ("r11_evidence_keys", "events"), ("sc13_lenient_json", "events"), ("js02_list_or_object", "events"), ("m15_angle_wrap", "events"), ("sc14_vector_literal", "embeddings")])
def test_every_row(name, table, spark, small):
    assert Q[name](spark, small).count() == spark.read.parquet(f"{small}/{table}.parquet").count()


def test_rule_conditions_of_all_cases(spark, small):
    got = Q["j17_rule_conditions"](spark, small)
    assert got.where("case_id % 20 <> 0").count() > 0 and got.where("case_id % 20 = 0").count() > 0


def test_whole_literals(spark, small):
    for r in Q["sc14_vector_literal"](spark, small).limit(5).collect():
        assert len(json.loads(r["literal"])) == 64 and all(len(x.split(".")[1]) == 8 for x in r["literal"][1:-1].split(","))


def test_half_a_turn_has_one_sign(spark, tmp_path):
    spark.createDataFrame([(1, math.pi), (2, -math.pi), (3, 3 * math.pi), (4, 0.5)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["wrapped"], r["wrapped2"]) for r in Q["m15_angle_wrap"](spark, str(tmp_path)).collect()}
    assert got == {1: (3.1415927,) * 2, 2: (3.1415927,) * 2, 3: (3.1415927,) * 2, 4: (0.5, 0.5)}


@pytest.mark.parametrize("name", ["m02_cosine_top_k", "m03_knn_mean_distance", "a23_identity_margin", "r01_identity_decision"])
def test_any_vector_is_found(name, spark, tmp_path):
    """The nearest vector of 0 is 50, a query itself; identities are looked for among authoritative vectors first."""
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.1], 2), (7, [0.0, 1.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["query_id"]: r for r in Q[name](spark, str(tmp_path)).collect() if r.asDict().get("rank", 1) == 1}
    assert set(got) == {0, 50}
    want = {"m02_cosine_top_k": ("other_id", 50), "m03_knn_mean_distance": ("knn_1", 0.1), "a23_identity_margin": ("label", 2), "r01_identity_decision": ("label", 3)}[name]  # 7 is authoritative
    assert got[0][want[0]] == pytest.approx(want[1])
