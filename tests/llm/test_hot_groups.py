"""Keys that hold a third of all rows: no task of a join gets them all, and results stay the same."""

import pytest
from pyspark.sql import functions as F

from watchplan.llm import common, exact_dedup, mixing, near_dedup


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)


@pytest.fixture
def without_broadcasts(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_groups(spark, few_rows, monkeypatch, how):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)  # the one large group fits, all groups don't
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"k{k % 50}" if k % 7 else None) for k in range(600)], "id long, key string").repartition(5)
    groups = rows.where("key <> 'k5'").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("_n"))
    got = common.join_groups(rows, groups, "key", 50, how)
    assert sorted(map(tuple, got.select("id", "key", "least").collect()), key=repr) == sorted(map(tuple, rows.join(groups, "key", how).select("id", "key", "least").collect()), key=repr)
    # the hot group's rows are where they were: they are in as many partitions as before
    places = got.where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert places == 5


def test_copies_of_a_third(spark, few_rows, without_broadcasts):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k // 2}") for k in range(300)] + [(None, "same text"), (7, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {}
    for r in exact_dedup.exact_groups(docs, memtable_rows=40).collect():
        got.setdefault((r.doc_id, r.keep_id, r.group_size), []).append(r.kept)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, []).append(i)
    for (doc_id, keep_id, size), kept in got.items():
        own = [t for t, ids in by_text.items() if doc_id in ids and len(ids) == size]
        assert keep_id in [max(i for i in by_text[t] if i is not None) for t in own]
    assert sum(k for v in got.values() for k in v) == len(by_text)
    left = exact_dedup.drop_copies(docs, keep="smallest")
    assert sorted(r.doc_id for r in left.collect()) == sorted(min(i for i in ids if i is not None) for ids in by_text.values())


def test_near_copies_of_a_third(spark, few_rows, without_broadcasts):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:59], f"x{k}"]) if k % 3 == 0 else f"own{k} words{k} of{k} this{k} text{k}") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_groups(docs, words=2).collect()}
    assert got == {k: (0, k == 0) if k % 3 == 0 else (k, True) for k, _ in rows}
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs, words=2).collect()) == sorted([0, *(k for k, _ in rows if k % 3)])


def test_rows_of_one_id_with_as_many_tokens(spark):
    """Which of them a leaf's last token falls on is the texts' own order, not the shuffle's."""
    rows = [(5, f"{w} one two three", "en", "src1") for w in ("a", "b", "c", "d", "e", "f")]
    frames = [spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(n) for n in (1, 2, 5)]
    kept = [sorted(r.text for r in mixing.keep_taken(f, budget_share=0.5, max_epochs=1.0).collect()) for f in frames]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3
