"""The queries of this subpackage, by name, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from watchplan.llm import bpe, chat, decontamination, exact_dedup, mixing, near_dedup, pii, resampling, sharding, token_counts, toxicity, twins, vector_codes, winnow
from watchplan.llm.common import bound_batches, table

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: English counts twice, the first domain half as much again as the others; rare sources may be read three times.
MIX = {"budget_share": 0.6, "max_epochs": 3.0, "weights": {"domain": {"domain0": 1.5}, "lang": {"en": 2.0}}, "seed": 7}


#: Where a session names the secret key of surrogates; without one, each run draws its own.
PII_KEY = "spark.watchplan.pii.key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; Python workers get it in batches bounded by bytes."""
    bound_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on 2-word shingles at 80 %: doc_id, n_shingles, component_id, kept.

    Null and empty texts and texts without words are linked with nothing; repeated rows and equal sets are one class;
    an empty table gives no rows; further columns are left out.
    """
    return near_dedup.near_groups(_documents(spark, sf_dir), words=2, percent=80)


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 in packs of shared turns, read back from them.

    Null roles and texts count as empty; repeated rows and rows of one turn number are turns each, in a fixed order; rows without
    conv_id are one conversation; an empty table gives conversation -7 alone.
    """
    bound_batches(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.packs(rows.unionByName(extra)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels of rows that aren't held out.

    Null and empty texts get the score of no features; rows that repeat a doc_id are scored each and count once as a sample;
    rows without doc_id aren't held out and never learned from; without labels every score is 0.
    """
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a budget of 60 % of all words takes, by weights of domains and languages.

    Null lang or source is 'none'; null and empty texts are never taken; repeated rows count each; an empty table gives no rows.
    """
    return mixing.mix(_documents(spark, sf_dir), **MIX)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null counts as empty and has no ids; a row for each row."""
    return bpe.token_digests(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_in_limit of every whole text; null counts as empty; a row for each row."""
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes; rows of equal texts, null and empty alike, share a shard; a row for each row."""
    return sharding.shards(_documents(spark, sf_dir), parts=16)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; null counts as empty, rows without doc_id come last; a row for each row."""
    return winnow.fingerprints(_documents(spark, sf_dir))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data; null and empty texts come back empty; a row for each row.

    The key is the session's spark.watchplan.pii.key; without one each run has a random key of its own, so that no
    published default can undo surrogates.
    """
    named = spark.conf.get(PII_KEY, None)
    return pii.replaced(_documents(spark, sf_dir), named.encode() if named else secrets.token_bytes(32))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its text, the one with the largest doc_id; null counts as empty; repeated rows are copies."""
    return exact_dedup.exact_groups(_documents(spark, sf_dir), keep="largest")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside windows of 10 words of the benchmark's items: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; a row for each row; without items nothing is hit; items of one item_id are one item.
    """
    return decontamination.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), words=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by 16 codebooks of 64 entries after two rounds: vec_id, code, error, label_error, codebooks_sha256.

    Null vectors and those with null or non-finite components go; a row for each other row; null labels are one label.
    """
    return vector_codes.codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the twentieth of them that is drawn: doc_id, n_features, weight, score, rank.

    Null and empty texts have no features and weight 0; a row for each row; documents below 20 words are never drawn.
    """
    return resampling.resampled(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), buckets=10_000, longest=3, least_words=20, percent=5, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_chat_prefix_tree, op3_toxicity, op4_mixing, op5_bpe, op6_token_counts, op7_sharding, op8_winnowing, op9_pii_surrogates, op10_exact_dedup, op11_decontamination, op12_vector_codes, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_decontamination": twins.DECONTAMINATION,
        "op12_vector_codes": twins.VECTOR_CODES,
        "op13_resampling": twins.RESAMPLING,
        "op4_mixing": _MIXING_SQL,
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
    }


def _deal_sql(source: str, by: str, level: str, out: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""
    {out}_a AS (SELECT *, w.lim / w.weight AS ratio FROM {source} w),
    {out}_b AS (SELECT *, greatest(0.0, budget - coalesce(sum(lim) OVER ({part}ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                   / sum(weight) OVER ({part}ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {out}_a),
    {out}_c AS (SELECT *, first_value(rate) OVER ({part}ORDER BY (ratio <= rate), ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM {out}_b),
    {out} AS (SELECT *, CASE WHEN ratio <= rate THEN lim ELSE least(lim, weight * common) END AS share FROM {out}_c)"""


_MIXING_SQL = f"""
WITH raw AS (
    SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
           len(list_filter(string_split(translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   '), ' '), lambda w: w <> '')) AS n_tokens
    FROM documents),
r AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'other'
                     ELSE 'domain' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 AS VARCHAR) END AS domain FROM raw WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, CAST(sum(n_tokens) AS DOUBLE) * 3.0 AS lim FROM r GROUP BY ALL),
d0 AS (SELECT domain, sum(lim) AS lim, CASE WHEN domain = 'domain0' THEN 1.5 ELSE 1.0 END AS weight,
              0.6 * (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_deal_sql("d0", "", "domain", "d1").strip()},
l0 AS (SELECT a.domain, a.lang, a.lim, CASE WHEN a.lang = 'en' THEN 2.0 ELSE 1.0 END AS weight, d1.share AS budget
       FROM (SELECT domain, lang, sum(lim) AS lim FROM leaves GROUP BY domain, lang) a JOIN d1 ON a.domain = d1.domain),
{_deal_sql("l0", "domain", "lang", "l1").strip()},
s0 AS (SELECT a.domain, a.lang, a.source, a.docs, a.tokens, a.lim, 1.0 AS weight, l1.share AS budget FROM leaves a JOIN l1 ON a.domain = l1.domain AND a.lang = l1.lang),
{_deal_sql("s0", "domain, lang", "source", "s1").strip()},
plan AS (SELECT domain, lang, source, tokens, CAST(floor(share + 1e-6) AS BIGINT) // tokens AS epochs, CAST(floor(share + 1e-6) AS BIGINT) % tokens AS tail FROM s1),
placed AS (SELECT r.*, p.epochs, p.tail, md5('7|' || CAST(r.doc_id AS VARCHAR)) AS h
           FROM r JOIN plan p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source),
run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(h, 1, 12), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM placed),
t AS (SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, epochs, CAST(greatest(0, least(n_tokens, tail - before)) AS BIGINT) AS tail_tokens FROM run)
SELECT *, epochs * n_tokens + tail_tokens AS taken_tokens FROM t WHERE epochs * n_tokens + tail_tokens > 0"""
