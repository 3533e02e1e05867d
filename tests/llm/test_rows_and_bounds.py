"""Rows are told apart by text, samples keep their bounds, large clusters and long pieces come out right, stages take odd rows."""

import itertools
import random
import time

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LONG, brute_near, by_key
from tokenizers import Tokenizer

from watchplan.llm import bpe, common, exact_dedup, mixing, near_dedup, token_counts, toxicity, winnow

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
A = "one two three four five six seven eight nine ten"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept(df):
    return by_key((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_by_row(spark):
    rows = [(5, A), (5, B), (3, B), (None, A), (7, ""), (7, ""), (8, None), (9, A.upper()), (9, A.upper())]
    assert kept(near_dedup.keep_one(docs_of(spark, rows))) == by_key([(5, A), (3, B), (7, ""), (7, ""), (8, None)])
    assert kept(near_dedup.keep_one(docs_of(spark, [(4, A), (4, A), (4, B)]))) == by_key([(4, A), (4, B)])


def test_mixing_by_row(spark):
    rows = [(1, A), (1, B), (None, A + " x"), (None, B + " y"), (2, ""), (3, None), *((k, f"{A} {k}") for k in range(10, 40))]
    df = docs_of(spark, rows)
    taken = mixing.mix(df, budget_share=0.5, max_epochs=1.0)
    left = mixing.keep_taken(df, budget_share=0.5, max_epochs=1.0)
    assert left.columns == df.columns and left.count() == taken.count() and kept(mixing.keep_taken(df, budget_share=1.0, max_epochs=1.0)) == by_key(r for r in rows if r[1])
    twice = [r for r in kept(left) if r[0] == 1]
    assert len(twice) == taken.where("doc_id = 1").count()
    few = mixing.keep_taken(df, budget_share=0.1, max_epochs=1.0)  # those that stay are fewer: the other side is joined
    assert few.count() == mixing.mix(df, budget_share=0.1, max_epochs=1.0).count() < len(rows) / 2


def test_one_boundary_bucket(spark, monkeypatch):
    """Prefixes over many buckets are those of one ordered run."""
    monkeypatch.setattr(mixing, "BUCKET", 5)
    r = random.Random(1)
    df = docs_of(spark, [(k, " ".join(["w"] * r.randrange(1, 30))) for k in range(400)])
    got = {x["doc_id"]: x["taken_tokens"] for x in mixing.mix(df, budget_share=0.37, max_epochs=2.0, seed=3).collect()}
    import hashlib

    order = sorted((int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:12], 16), i, len(t.split())) for i, t in ((x["doc_id"], x["text"]) for x in df.collect()))
    left = int(0.37 * sum(n for _, _, n in order) + 1e-6)
    want = {}
    for _, i, n in order:
        if min(n, left):
            want[i] = min(n, left)
        left -= min(n, left)
    assert got == want


def test_sample_keeps_its_bounds(spark):
    rows = [(k, f"calm word{k} here") for k in range(100)] + [(7, f"text {k} of one id") for k in range(200)] + [(200 + k, f"bad word{k}") for k in range(30)] * 3
    labels = spark.createDataFrame([(200 + k, 1) for k in range(30)] * 4 + [(k, 0) for k in range(50)], "doc_id long, toxic int")
    df = docs_of(spark, rows)
    sample, prior = toxicity.sampled(common.texts(df), labels, None, 10, 25)
    assert len(sample) == len(set(sample)) == 35 and 0 < prior < 1
    seen = []
    real = toxicity.fit
    try:
        toxicity.fit = lambda ids, positive, unlabelled, *a, **k: seen.append((len(positive), len(unlabelled))) or real(ids, positive, unlabelled, *a, **k)
        toxicity.train(df, labels, most_positive=10, most_unlabelled=25)
        toxicity.train(df, labels)
    finally:
        toxicity.fit = real
    assert seen[0] == (10, 25) and seen[1][0] <= 30 and seen[1][1] <= 130


def test_risk_as_by_hand():
    """The two parts of the risk, one text after another, and the gradient by small differences."""
    rng = np.random.default_rng(3)
    for shift in (2.0, -6.0):  # the clean part is positive, then negative
        f = rng.normal(size=12) + np.where(np.arange(12) < 5, 3.0, shift)
        is_p, prior = np.arange(12) < 5, 0.4
        loss = lambda z: float(np.log1p(np.exp(-z)))
        toxic = prior * sum(loss(z) for z in f[:5]) / 5
        clean = sum(loss(-z) for z in f[5:]) / 7 - prior * sum(loss(-z) for z in f[:5]) / 5
        a, b, grad = toxicity.risk(f, is_p, prior)
        assert np.allclose([a, b], [toxic, clean]) and (clean >= 0) == (shift > 0)
        goal = (lambda z: sum(toxicity.risk(z, is_p, prior)[:2])) if clean >= 0 else (lambda z: -toxicity.risk(z, is_p, prior)[1])
        near = [(goal(f + 1e-6 * e) - goal(f - 1e-6 * e)) / 2e-6 for e in np.eye(12)]
        assert np.allclose(grad, near, atol=1e-7)


@pytest.mark.parametrize("block", [16, 1024])
def test_clusters_of_several_parts(spark, monkeypatch, block):
    """Large groups, chains and stragglers: blocks of a band's largest part don't meet each other, and nothing is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{k}" for k in range(60)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
        return " ".join(words)

    texts = [edited(base, r.choice([1, 1, 1, 2, 3, 4, 6])) for _ in range(300)] + [" ".join(f"c{j}" for j in range(3 * k, 3 * k + 60)) for k in range(15)] + [edited(base[:40], 1) for _ in range(40)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = [tuple(x) for x in near_dedup.near_groups(docs_of(spark, rows), 2, 80).collect()]
    assert by_key(got) == by_key(brute_near(rows, 2, 80))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_many_runs_in_levels(spark, keep):
    r = random.Random(1)
    rows = [(k if k % 50 else None, f"t{r.randrange(700)}") for k in range(2000)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_groups(docs_of(spark, rows).repartition(5), keep, memtable_rows=60, fan=3).collect()  # some 35 runs: four levels
    best = max if keep == "largest" else min
    want = {t: (best((i for i in own if i is not None), default=None), len(own)) for t, own in groups.items()}
    of = {i: t for i, t in rows if i is not None}
    assert all((x["keep_id"], x["group_size"]) == want[of[x["doc_id"]]] for x in got if x["doc_id"] is not None)
    assert len(got) == 2000 and sum(x["kept"] for x in got) == len(groups)


def test_compaction_holds_no_more_as_runs_grow():
    """A block of the next level has as many keys as one of this level, on average."""
    rng = np.random.default_rng(0)
    run = lambda n: np.sort(rng.integers(0, 256, (n, 32), np.uint8).copy().view("V32").ravel()).view(np.uint8).reshape(-1, 32)
    entries = lambda k: np.array([(i, i, 1, 1) for i in range(len(k))], exact_dedup._ROW).tobytes()
    runs = [(k.tobytes(), exact_dedup._packed_filter(k, 1 << 14), entries(k)) for k in (run(500) for _ in range(16))]
    keys, best = exact_dedup.merged(runs, False)
    assert len(keys) == len(best) == 8000 and max(np.bincount(keys[:, 4] % 16)) < 700


def test_rolling_hash_step_by_step():
    points = np.frombuffer("rolling over жизнь and \U0001f600 again".encode("utf-32-le"), "<u4")
    own = [int(x) for x in winnow._mix(points.astype(np.uint64) + np.uint64(1))]
    for gram in (1, 2, 7, 16, len(own)):
        now = sum(c * pow(winnow.BASE, m, 1 << 64) for m, c in enumerate(own[:gram])) % (1 << 64)
        for at, h in enumerate(winnow.rolling(points, gram).tolist()):
            assert h == now
            if at + gram < len(own):
                now = ((now - own[at]) * winnow._INVERSE + own[at + gram] * pow(winnow.BASE, gram - 1, 1 << 64)) % (1 << 64)


def test_fingerprints_of_rows_without_or_with_one_id(spark):
    r = random.Random(2)
    rows = [(None if r.random() < 0.3 else 5 if r.random() < 0.4 else r.randrange(40), "".join(r.choices("ab c", k=r.randrange(0, 30)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    h = {x["text"]: x["h"] for x in df.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, h[x[1]], x[1]))
    want = [(i, len(t), winnow.as_string(winnow.fingerprint(t)), winnow.as_string(winnow.fingerprint(winnow.edited(t, order[(k + 1) % 400][1])))) for k, (i, t) in enumerate(order)]
    got = [(x["doc_id"], x["n_chars"], x["fingerprint"], x["edited_fingerprint"]) for x in winnow.fingerprints(df).collect()]
    assert by_key(got) == by_key(want)
    sizes = [x["count"] for x in winnow.with_next(df).where("own").groupBy("bucket").count().collect()]
    assert max(sizes) < 100  # of 400 rows, 120 without an id and 110 with the same one


def test_stored_prefix_counts(spark):
    t = Tokenizer.from_file(VOCABULARY)
    texts = ["  two  blanks don't 'll aaaa\n\n x", "Ünïcode жизнь 日本語 \U0001f600!!", "a<|endoftext|>b <|endof 're", "'", "", None]
    stored = token_counts.prefix_counts(docs_of(spark, list(enumerate(texts))), VOCABULARY).cache()
    limits, places = range(0, 30, 3), range(0, 45, 4)
    columns = [token_counts.tokens_at(F.col("steps"), k).alias(f"a{k}") for k in places] + [token_counts.longest_within(F.col("steps"), n).alias(f"l{n}") for n in limits]
    for r in stored.select("doc_id", "n_tokens", *columns).collect():
        text = texts[r["doc_id"]] or ""
        want = [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert r["n_tokens"] == want[-1] and [r[f"a{k}"] for k in places] == [want[min(k, len(text))] for k in places]
        assert [r[f"l{n}"] for n in limits] == [max(k for k, m in enumerate(want) if m <= n) for n in limits]
    stored.unpersist()


def test_prefixes_of_odd_texts():
    t, counter, r = Tokenizer.from_file(VOCABULARY), token_counts.PrefixCounter(bpe.Vocabulary(VOCABULARY)), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'ll", "'re", "'s", "?", "!", "1", "23", "é", "жи", "日", "<|endoftext|>", "<|", "the", "\t", "\x85", "　", "́", "_", "½", "​"]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 14))) for _ in range(400)]
    for text, _, n, counts in counter.batch(texts):
        want = [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counts.tolist() == want and n == want[-1]


@pytest.mark.parametrize("text", ["".join(random.Random(4).choices("etaoinshrdlucmfw", k=300_000)), "a" * 50_000, "ab" * 30_000, " " * 60_000 + "x", "日本" * 15_000], ids=["letters", "one", "two", "blanks", "wide"])
def test_very_long_pieces(text):
    began = time.time()
    t, v = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary(VOCABULARY)
    want = t.encode(text, add_special_tokens=False).ids
    assert next(iter(bpe.Encoder(v)([text]))).tolist() == want
    assert token_counts.PrefixCounter(v).total(text) == len(want)
    assert time.time() - began < 60


def test_components_raise_if_they_do_not_settle(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    folder = common.workspace(spark)
    assert {r["root"] for r in common.components(chain, folder, "whole").collect()} == {0}
    with pytest.raises(RuntimeError, match="settled"):
        common.components(chain, folder, "short", most_rounds=2)


def test_stages_take_odd_rows(spark, small, tmp_path):
    """Null, empty, repeated, very long and id-less rows, and columns that clash with the stages' own, at every stage."""
    rows = [
        (1, None), (2, ""), (3, A), (3, B), (3, A), (None, "no identifier at all here"), (None, None), (4, A + " eleven"), (5, A.upper()), (6, LONG), (7, LONG + " tail"), (8, "\n\t "), (9, "same ones"), (10, "same ones"),
    ]
    df = docs_of(spark, rows).selectExpr("*", "5L AS nid", "'k' AS key", "'s' AS sha", "1 AS bucket", "'x' AS stays", "2L AS n_tokens", "7L AS root", "8L AS component_id")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        for source in (df.limit(0), df):
            path = f"file://{tmp_path}/{name}-{source is df}"
            stage(spark, source, small).write.parquet(path)
            out = spark.read.parquet(path)
            if source is df:
                steps[name] = out
                assert name == "bpe_encoding" or out.columns == df.columns
            else:
                assert out.count() == 0
    # none of these says anything toxic
    assert steps["toxicity"].count() == len(rows)
    texts = {t or "" for _, t in rows}
    assert sorted(r["text"] or "" for r in steps["exact_dedup"].collect()) == sorted(texts)
    near = steps["near_dedup"].collect()
    blank = [r for r in near if not (r["text"] or "").strip()]
    assert len(blank) == 4 and len({r["text"] for r in near if r not in blank}) == len(near) - len(blank)
    assert (3, B) in kept(steps["near_dedup"]) and (3, A) in kept(steps["near_dedup"])
    ids = {(r["doc_id"], r["n_tokens"]) for r in steps["bpe_encoding"].collect()}
    t = Tokenizer.from_file(VOCABULARY)
    assert steps["bpe_encoding"].count() == len(rows) and ids == {(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows}
    assert all(r["taken"] for r in steps["mixing"].select(F.length(F.trim("text")).alias("n")).selectExpr("n > 0 AS taken").collect())
    assert list(itertools.islice((n for n, _ in corpus_pipeline.STAGES), 5)) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe_encoding"]
