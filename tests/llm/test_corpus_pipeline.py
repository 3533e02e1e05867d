"""The stages of the corpus pipeline against brute-force versions, each on its own input."""

import corpus_pipeline
import pytest
from test_llm_operators import brute_near, rows_of
from tokenizers import Tokenizer

from watchplan.llm import mixing, toxicity


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """(name, input, output) of each stage, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, small).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(steps):
    for name, (before, after) in steps.items():
        assert name == "bpe_encoding" or after.columns == before.columns


def test_toxic_ones_go(spark, small, steps):
    before, after = steps["toxicity"]
    score = toxicity.train(before, spark.read.parquet(f"{small}/labels.parquet")).scorer()
    assert ids(after) == sorted(i for i, t in rows_of(before) if score(t) < 0.5)


def test_one_copy_stays(steps):
    before, after = steps["exact_dedup"]
    least: dict[str, int] = {}
    for i, t in rows_of(before):
        least[t] = min(i, least.get(t, i))
    assert ids(after) == sorted(least.values())


def test_one_near_copy_stays(steps):
    before, after = steps["near_dedup"]
    assert ids(after) == sorted(i for i, _, _, kept in brute_near(rows_of(before), 2, 80) if kept)


def test_mixing_keeps_what_is_taken(steps):
    before, after = steps["mixing"]
    taken = mixing.mix(before, budget_share=0.9, max_epochs=1.0).toPandas()
    assert ids(after) == sorted(taken["doc_id"]) and taken["epochs"].max() <= 1
    words = sum(len(t.split()) for _, t in rows_of(before))
    assert taken["taken_tokens"].sum() == pytest.approx(0.9 * words, abs=30)


def test_ids_as_the_library(spark, small, steps):
    before, after = steps["bpe_encoding"]
    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: t.encode(text, add_special_tokens=False).ids for i, text in rows_of(before)}
    got = {r["doc_id"]: r["ids"] for r in after.collect()}
    assert got == want
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, small).collect()} == want
