"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, encoding.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns token ids.
SQL can't express the classifier, so there is no ORACLE_SQL; tests compare with a brute-force version.

Rows without doc_id, null and empty texts, repeated rows, very long texts and further columns are allowed at every
stage; an empty table stays empty.  Decisions go by doc_id and text, so rows that repeat a doc_id with other texts
are rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchplan.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from watchplan.llm.common import bound_batches, table, workspace, written

ORACLE_SQL = None
TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are predicted toxic go; null and empty texts stay.  The classifier learns from labels of docs' own rows."""
    bound_batches(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that with the smallest doc_id (null ids last); null and empty texts are one text."""
    bound_batches(spark)
    return exact_dedup.drop_copies(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the least doc_id; links are 80 % of two-word shingles, as in op1; texts without words all stay."""
    bound_batches(spark)
    return near_dedup.keep_one(docs, words=2, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is taken at most once, whole; the hot source gives way to the others; texts without words go."""
    bound_batches(spark)
    return mixing.keep_taken(docs, budget_share=0.9, max_epochs=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row; a null text counts as empty and has no ids."""
    bound_batches(spark)
    ids = bpe.encode(docs, public_tokenizers.path(TOKENIZER), with_text=False)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows a written table that the next one reads."""
    docs, folder = table(spark, sf_dir, "documents"), workspace(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
