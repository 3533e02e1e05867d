"""Nearest neighbours through inverted lists.

Centres come from k-means on a bounded sample; every vector is in the list of its nearest centre, packed in blocks, so a
large list is many blocks.  A query meets the blocks of the lists that it probes, by an equi-join on the list.
Approximate: the nearest few lists.  Exact: these first, then each list that can still hold a nearer vector than the k-th one found,
by the distance of its centre less its radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.operators.joins import small
from watchplan.operators.matching import BLOCK, best_in_blocks, costs, one_by_one, ranked
from watchplan.sources.shared import written

#: Bounds of the sample that the centres are fitted to: vectors for each list, and bytes of all.
SAMPLE_PER_LIST, SAMPLE_BYTES = 64, 32 << 20
#: Blocks of queries are broadcast up to so many bytes, else shuffled.
BROADCAST_BYTES = 16 << 20
#: Lists at most; their centres are in every task.
MOST_LISTS = 4096
_PACKED = "list int, ids array<long>, vectors binary"


@dataclass(frozen=True)
class Index:
    """centres and radius of each list; blocks: (list, ids, vectors packed).  The list after the last centre has the vectors without length."""

    centres: np.ndarray
    radius: np.ndarray
    blocks: DataFrame
    metric: str


def _located(v: np.ndarray, metric: str) -> np.ndarray:
    """Where the lists have a vector: on the unit sphere for cosine, where distance and similarity order alike."""
    if metric != "cosine":
        return v
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def centres_of(v: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means from distinct vectors of the sample; a list without any keeps its centre."""
    distinct = np.unique(v, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        own = np.concatenate([costs(v[k : k + 4096], c, "euclidean")[1].argmin(1) for k in range(0, len(v), 4096)])
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _packed(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(list, ids, vectors) in blocks of at most BLOCK; rows are (list, id, v), sizes (list, n), from which a list is dealt to several tasks."""
    rows = rows.withColumn("deal", F.lit(0)) if sizes is None else rows.join(F.broadcast(sizes), "list").withColumn("deal", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))).drop("n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, vs = None, [], []

        def block() -> tuple:
            return at[0], ids, b"".join(vs)

        for pdf in batches:
            out = []
            for own, deal, i, v in zip(pdf["list"], pdf["deal"], pdf["id"], pdf["v"], strict=True):
                if ids and (at != (own, deal) or len(ids) == BLOCK):
                    out.append(block())
                    ids, vs = [], []
                at = (own, deal)
                ids.append(i)
                vs.append(np.asarray(v, np.float64).tobytes())
            yield pd.DataFrame(out, columns=["list", "ids", "vectors"])
        if ids:
            yield pd.DataFrame([block()], columns=["list", "ids", "vectors"])

    return rows.select("list", "deal", "id", "v").repartition("list", "deal").sortWithinPartitions("list", "deal", "id").mapInPandas(run, _PACKED)


def build(gallery: DataFrame, folder: str, lists: int | None = None, metric: str = "cosine", key: str = "vec_id", vector: str = "v") -> Index:
    """The index of all vectors of the gallery, its tables in folder; rows without a vector are left out.

    lists: the square root of the gallery's rows unless given, MOST_LISTS at most.  All vectors have one length.
    """
    rows = gallery.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    lists = min(MOST_LISTS, max(1, lists or round(n**0.5)))
    want = max(lists, min(SAMPLE_PER_LIST * lists, SAMPLE_BYTES // (8 * max(dim or 1, 1))))
    cut = 1 << 30 if n <= want else int((1 << 30) * want / n)
    sample = [r["v"] for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < cut).limit(want).collect()]  # the bounded sample
    located = _located(np.array(sample, np.float64).reshape(len(sample), -1), metric) if sample else np.zeros((0, dim or 1))
    located = located[np.linalg.norm(located, axis=1) > 0] if metric == "cosine" else located
    centres = centres_of(located, lists) if len(located) else np.zeros((1, dim or 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = _located(_matrix(pdf["v"]), metric)
                far = costs(at, centres, "euclidean")[1]
                own = far.argmin(1)
                off = far[np.arange(len(at)), own]
                none = (np.linalg.norm(at, axis=1) == 0) & (metric == "cosine")
                yield pd.DataFrame({"list": np.where(none, len(centres), own), "id": pdf["id"], "v": pdf["v"], "off": off})

    placed = written(rows.mapInPandas(run, "list int, id long, v array<double>, off double"), f"{folder}/placed")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("off"))
    radius = np.full(len(centres) + 1, -np.inf)  # an empty list is never worth a probe
    for r in sizes.collect():  # a row for each list
        radius[r["list"]] = r["off"] if r["list"] < len(centres) else np.inf
    return Index(centres, radius, written(_packed(placed, sizes.select("list", "n")), f"{folder}/blocks"), metric)


def _probed(queries: DataFrame, index: Index, probes: int, bound: str | None = None) -> DataFrame:
    """(list, id, v): each query with the lists that it meets: the nearest probes, or, with a column `bound`, the others that may hold less than it."""
    centres, radius, metric = index.centres, index.radius, index.metric

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or np.isneginf(radius).all():  # nothing to search
                continue
            at = _located(_matrix(pdf["v"]), metric)
            far = np.concatenate([costs(at, centres, "euclidean")[1], np.full((len(at), 1), np.inf)], 1)
            if metric == "cosine":
                far[np.linalg.norm(at, axis=1) == 0] = 0  # unlike all: order says nothing
            rank = far.argsort(1, kind="stable").argsort(1)
            take = rank < probes
            if bound is not None:
                least = np.where(np.isposinf(radius), -np.inf, far - np.where(np.isfinite(radius), radius, 0))
                if metric == "cosine":
                    least[np.linalg.norm(at, axis=1) == 0] = -np.inf
                take = ~take & ~np.isneginf(radius) & (least <= pdf["bound"].to_numpy()[:, None] + 1e-9)
            q, own = np.nonzero(take)
            yield pd.DataFrame({"list": own, "id": pdf["id"].to_numpy()[q], "v": pd.Series(pdf["v"].iloc[q].tolist(), dtype=object)})

    return queries.mapInPandas(run, "list int, id long, v array<double>")


def _met(probed: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, other_id, value: the best k of each block for each query that probes its list."""
    metric = index.metric
    q = _packed(probed).select("list", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    few = max(1, BROADCAST_BYTES // (8 * BLOCK * index.centres.shape[1]))  # each row is a block of vectors
    pairs = index.blocks.join(small(q, few), "list").select("q_ids", "q_vectors", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in best_in_blocks(one_by_one(batches), metric, k):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return pairs.mapInArrow(run, "query_id long, other_id long, value double")


def search(queries: DataFrame, index: Index, k: int, folder: str, probes: int = 8, exact: bool = False, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """query_id, other_id, value, rank: the k nearest for each query, itself left out, ties by id; queries without a vector have none.

    exact: the same rows as a comparison with the whole gallery; else only the nearest probes lists are searched.
    """
    q = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    found = _met(_probed(q, index, probes), index, k)
    if not exact:
        return ranked(found, k, index.metric)
    found = written(ranked(found, k, index.metric).drop("rank"), f"{folder}/probed")
    worst = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("value"))) if index.metric == "cosine" else F.max("value")
    last = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, worst).alias("bound"))
    bounded = q.join(small(last), q["id"] == last["query_id"], "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return ranked(found.unionByName(_met(_probed(bounded, index, probes, "bound"), index, k)), k, index.metric)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, recall: the share of the true neighbours that were found."""
    hit = truth.select("query_id", "other_id").join(found.select("query_id", "other_id", F.lit(1).alias("hit")), ["query_id", "other_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def probes_for(sample: DataFrame, index: Index, k: int, folder: str, least: float = 0.9, key: str = "vec_id", vector: str = "v") -> int:
    """How many probes find `least` of the k true neighbours of a sample of queries, by doubling; all lists at most.

    How vectors cluster decides it: in clear clusters a few lists hold all neighbours, in a shapeless cloud of many dimensions most are needed.
    """
    truth = written(search(sample, index, k, folder, exact=True, key=key, vector=vector), f"{folder}/truth")
    probes, most = 1, len(index.radius)
    while probes < most:
        share = recall(search(sample, index, k, folder, probes, key=key, vector=vector), truth).agg(F.avg("recall")).first()[0]
        if share is None or share >= least:
            return probes
        probes *= 2
    return most
