"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of any texts is the unlabelled set, a mixture in
which a share `prior` is toxic.  The risk is  prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]):
the second term estimates the clean part's loss and is kept from going below zero, or the model
would fit the positives hidden in the unlabelled set.  Only texts are inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import texts, workspace, written

#: Hashed features, and the bounds of the training sample: confirmed toxic texts, unlabelled texts.
FEATURES, MOST_POSITIVE, MOST_UNLABELLED = 1 << 20, 2_500, 6_000
#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are held out.
FOLDS = 5
_words = re.compile(r"[^\W\d_]+").findall
_CACHE = 400_000


def features(word: str) -> tuple[int, ...]:
    """A word, and its first 4, 5 and 6 letters for words of many endings, as hashed features."""
    return tuple({zlib.crc32(f"{n} {word[:n]}".encode()) % FEATURES for n in (4, 5, 6, 99) if len(word) >= min(n, 2)})


@dataclass
class Model:
    ids: np.ndarray  # features with a weight, ascending
    weights: np.ndarray
    bias: float

    def scorer(self):
        weight, known = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True)), {}

        def score(text: str) -> float:
            if len(known) > _CACHE:
                known.clear()
            met: set[int] = set()
            for word in set(_words(text.lower())):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(f for f in features(word) if f in weight)
                met.update(own)
            return 1 / (1 + np.exp(-np.clip(self.bias + sum(weight[f] for f in sorted(met)), -40, 40)))

        return score


def risk(f: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, estimate of the clean part, gradient by f of what a step goes down) at outputs f; is_p: confirmed positives, the rest unlabelled.

    While the clean part's estimate is not negative, the step goes down the whole risk; else back up that estimate alone.
    """
    n_p, n_u = max(1, int(is_p.sum())), max(1, int((~is_p).sum()))
    up = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # d loss(-) / d f;  d loss(+) / d f = up - 1
    minus = np.logaddexp(0, f)
    toxic = prior * np.logaddexp(0, -f)[is_p].sum() / n_p
    clean = minus[~is_p].sum() / n_u - prior * minus[is_p].sum() / n_p
    of_clean = np.where(is_p, -prior * up / n_p, up / n_u)
    return toxic, clean, np.where(is_p, prior * (up - 1) / n_p, 0) + of_clean if clean >= 0 else -of_clean


def fit(ids: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, l2: float = 7e-4) -> Model:
    """A linear model over sets of the features ids, with the non-negative risk above and logistic loss.

    Without positives every score is 0.
    """
    if not positive:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    prior = min(max(prior, 1e-4), 0.9)
    np_ = len(positive)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, f in enumerate([*positive, *unlabelled]):
        cols.append(np.searchsorted(ids, np.sort(f)))
        rows.append(np.full(len(f), k))
    row, col = np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64)
    n, is_p = np_ + len(unlabelled), np.arange(np_ + len(unlabelled)) < np_
    w, b = np.zeros(ids.size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(ids.size + 1), np.zeros(ids.size + 1)
    for step in range(1, rounds + 1):
        f = b + np.bincount(row, w[col], n)
        grad = risk(f, is_p, prior)[2]
        g = np.append(np.bincount(col, grad[row], ids.size) + l2 * w, grad.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    keep = np.abs(w) > 1e-3
    return Model(ids[keep], w[keep], float(b))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most: int = 10_000, share: float = 0.01) -> Model:
    """Fits on at most most_positive confirmed toxic and most_unlabelled unlabelled texts, each the first distinct ids by a hash of doc_id.

    prior: the share of toxic texts; None: that among the labelled rows which aren't held out.  Labels,
    toxic or not, of held-out rows are never read.  An id counts once, with one text (the least by digest, if rows
    repeat the id with other texts), so the sample never exceeds its bounds; more rows would be an error.

    Weights go to at most `most` features: those more than 3 times as frequent among positives that a share
    of them has (copies of one text lend their words no weight), the most significant first.  They are found
    by a distributed count over the sample; only they, and the sample's sets of them, reach the driver.
    Features and penalty follow the number n of positives smoothly: z >= 3 - 200 / (200 + n), l2 = 7e-4 + 0.06 / (200 + n).
    """
    spark, rows = docs.sparkSession, texts(docs).where("doc_id is not null and text <> ''")
    chosen, prior = sampled(rows, labels, prior, most_positive, most_unlabelled)
    sample = spark.createDataFrame(chosen, "doc_id long, own int")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [sorted({f for w in set(_words(t.lower())) for f in features(w)}) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "own": pdf["own"], "features": sets})

    folder = workspace(spark)
    # one text an id, chosen by digest before the texts are read again: texts themselves aren't shuffled
    mine = rows.join(F.broadcast(sample), "doc_id").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    one = written(mine.groupBy("doc_id", "own").agg(F.min("sha").alias("sha")), folder, "chosen")
    took = mine.join(F.broadcast(one), ["doc_id", "own", "sha"]).select("doc_id", "own", "text")
    got = written(took.mapInPandas(featurise, "doc_id long, own int, features array<int>").dropDuplicates(["doc_id", "own"]), folder, "sample")
    n = {r["own"]: r["n"] for r in got.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = n.get(1, 0), max(1, n.get(0, 0))
    if n_p > most_positive or n.get(0, 0) > most_unlabelled:
        raise RuntimeError(f"a sample of {n_p} and {n_u} texts, beyond {most_positive} and {most_unlabelled}")
    each = got.select("doc_id", "own", F.explode("features").alias("f"))
    usual = n_p * (F.col("cu") + 0.5) / n_u
    told = each.groupBy("f").agg(F.sum("own").alias("cp"), F.sum(1 - F.col("own")).alias("cu")).withColumn("z", (F.col("cp") - usual) / F.sqrt(usual + 1))
    told = told.where((F.col("cp") >= max(2.0, share * n_p)) & (F.col("cp") > 3 * usual) & (F.col("z") >= 3 - 200 / (200 + n_p))).orderBy(F.desc("z"), "f").limit(most)
    ids = np.array(sorted(r["f"] for r in told.select("f").collect()), np.int64)
    chosen_f = spark.createDataFrame([(int(f),) for f in ids], "f int")
    sets = each.join(F.broadcast(chosen_f), "f").groupBy("own", "doc_id").agg(F.sort_array(F.collect_list("f")).alias("f")).orderBy("own", "doc_id").collect()
    own = {1: [], 0: []}
    for r in sets:
        own[r["own"]].append(np.array(r["f"], np.int64))
    none = np.zeros(0, np.int64)
    return fit(ids, own[1] + [none] * (n_p - len(own[1])), own[0] + [none] * (n.get(0, 0) - len(own[0])), prior, l2=7e-4 + 0.06 / (200 + n_p))


def sampled(rows: DataFrame, labels: DataFrame, prior: float | None, most_positive: int, most_unlabelled: int) -> tuple[list[tuple[int, int]], float]:
    """(doc_id, 1 for confirmed toxic or 0 for unlabelled) of the sample, ids distinct within each, and the prior."""
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    if prior is None:
        prior = seen.agg(F.avg("toxic")).first()[0] or 0.1
    first = lambda df, seed, most, own: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).select("doc_id", F.lit(own).alias("own"))
    both = first(seen.where("toxic = 1"), 17, most_positive, 1).unionByName(first(rows.where(~held_out()), 18, most_unlabelled, 0))
    return [tuple(r) for r in both.collect()], prior  # bounded by the two limits


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text; null and empty texts get the score of no features.

    The model (bounded by fit's `most`) is broadcast; scoring is one pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value.scorer()
        for texts_ in batches:
            yield texts_.map(f).astype("float64")

    rows = texts(docs).withColumn("score", scored("text"))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value.scorer()
        for texts_ in batches:
            yield texts_.map(lambda t: f(t or "") < 0.5).astype(bool)

    return docs.where(fine(F.col("text").cast("string")))
