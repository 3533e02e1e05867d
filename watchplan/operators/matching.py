"""Vector matching: cosine top-k, identity decisions, nearest-neighbour distances.

A stated set of queries meets a gallery of any size in blocks: vectors are packed into blocks, each pair of
a query block and a gallery block is one matrix product in some task, and only each query's best k of
a block go on to the merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and blocks of queries that are broadcast at once.
BLOCK, CHUNK = 2048, 8
#: Costs that a task holds at once, of each kind.
CELLS = 1 << 19


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def _packed(df: DataFrame, key: str, vector: str, side: str, blocks: int) -> DataFrame:
    """A row per block: its ids and its vectors, one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        for pdf in batches:
            out = []
            for b, i, v in zip(pdf["b"], pdf["id"], pdf["v"], strict=True):
                ids, vs = held.setdefault(b, ([], []))
                ids.append(i)
                vs.append(np.asarray(v, np.float64).tobytes())
                if len(ids) == BLOCK:
                    out.append((b, ids, b"".join(vs)))
                    del held[b]
            yield pd.DataFrame(out, columns=[f"{side}_block", f"{side}_ids", f"{side}_vectors"])
        yield pd.DataFrame([(b, i, b"".join(v)) for b, (i, v) in held.items()], columns=[f"{side}_block", f"{side}_ids", f"{side}_vectors"])

    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return dealt.mapInPandas(run, f"{side}_block int, {side}_ids array<long>, {side}_vectors binary")


def costs(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(value, cost) of each row of a with each row of b; the least cost is the best."""
    if metric == "cosine":
        na, nb = (np.linalg.norm(x, axis=1) for x in (a, b))
        scale = np.outer(na, nb)
        value = np.divide(a @ b.T, scale, out=np.zeros((len(a), len(b))), where=scale > 0)
        return value, -value
    value = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))
    return value, value


def best_of(query_ids: np.ndarray, ids: np.ndarray, value: np.ndarray, cost: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, other_id, value of the k least costs of each row, itself left out; ties by id."""
    cost = np.round(np.where(query_ids[:, None] == ids[None, :], np.inf, cost), 12)
    last = np.partition(cost, k - 1, axis=1)[:, k - 1 : k] if k < len(ids) else np.inf
    rows, cols = np.nonzero((cost <= last) & np.isfinite(cost))
    order = np.lexsort((ids[cols], cost[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    ok = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    rows, cols = rows[ok], cols[ok]
    return pd.DataFrame({"query_id": query_ids[rows], "other_id": ids[cols], "value": value[rows, cols]})


def best_in_blocks(pairs: Iterator[tuple], metric: str, k: int) -> Iterator[pd.DataFrame]:
    """best_of the block pairs (query ids, query vectors, ids, vectors, ...), followed by what else a pair has, CELLS costs at once."""
    for qi, qv, gi, gv, *more in pairs:
        a, b = (np.frombuffer(v, np.float64).reshape(len(i), -1) for v, i in ((qv, qi), (gv, gi)))
        qi, gi = np.asarray(qi), np.asarray(gi)
        step = max(1, CELLS // max(1, len(b)))
        for at in range(0, len(a), step):
            out = best_of(qi[at : at + step], gi, *costs(a[at : at + step], b, metric), k)
            yield out.assign(first=more[0]) if more else out


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, each made into Python values alone."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            yield tuple(c[0].as_py() if not pa.types.is_list(c.type) else c.flatten().to_numpy() for c in row.columns)


def ranked(best: DataFrame, k: int, metric: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query, by rank; ties by id."""
    near = F.round(F.col("value"), 12)
    w = Window.partitionBy(*by).orderBy(near.desc() if metric == "cosine" else near.asc(), "other_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "v", first: str | None = None) -> DataFrame:
    """query_id, other_id, value, rank: the k nearest of the gallery for each query, itself left out.

    cosine: greatest similarity first; euclidean: least distance first; ties by id.  Exact: every pair is
    compared.  Queries are broadcast as packed blocks, CHUNK at a time: each chunk is one more scan of the gallery, which
    itself is never shuffled, and memory is a chunk and a gallery block, however many queries there are.

    first: a boolean column of the gallery.  Then a query's neighbours are the k nearest of the rows for which it is true, and
    of all rows only where it has none of those; a further column `first` says which.  Both searches share one pass.
    """
    n = queries.count()
    q_blocks = max(1, -(-n // BLOCK))
    q = _packed(queries, key, vector, "q", q_blocks)
    g = _packed(gallery, key, vector, "g", 1)
    if first is not None:  # blocks of one kind each
        kinds = [(True, gallery.where(F.coalesce(first, F.lit(False)))), (False, gallery.where(~F.coalesce(first, F.lit(False))))]
        g = reduce(DataFrame.unionByName, [_packed(rows, key, vector, "g", 1).withColumn("g_first", F.lit(kind)) for kind, rows in kinds])
    # a stated set of queries, in bounded chunks, against all rows
    chunks = [g.drop("g_block").crossJoin(F.broadcast(q.where(F.floor(F.col("q_block") / CHUNK) == k).drop("q_block"))) for k in range(-(-q_blocks // CHUNK))]
    pairs = reduce(DataFrame.unionByName, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in best_in_blocks(one_by_one(batches), metric, k):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    columns, schema = ["q_ids", "q_vectors", "g_ids", "g_vectors"], "query_id long, other_id long, value double"
    if first is None:
        return ranked(pairs.select(*columns).mapInArrow(run, schema), k, metric)
    best = pairs.select(*columns, "g_first").mapInArrow(run, schema + ", first boolean")
    return ranked(_staged(best), k, metric)


def _staged(best: DataFrame) -> DataFrame:
    """Of a query's neighbours those of the first stage, or, where it has none, all; `first` says which stage it is."""
    stage = F.max("first").over(Window.partitionBy("query_id"))
    return best.withColumn("_stage", stage).where(F.col("first") | ~F.col("_stage")).drop("first").withColumnRenamed("_stage", "first")


def identities(top: DataFrame, labels: DataFrame) -> DataFrame:
    """Best similarity per identity over the top rows, then the best two identities and their margin.

    labels: (other_id, label).  One identity alone has no margin (null).
    """
    per = top.join(labels, "other_id").groupBy("query_id", "label").agg(F.max("value").alias("best"))
    two = F.slice(F.sort_array(F.collect_list(F.struct(F.col("best").alias("sim"), (-F.col("label")).alias("neg"))), asc=False), 1, 2)  # at most k identities a query
    got = per.groupBy("query_id").agg(two.alias("t"))
    first, second = F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(2))
    return got.select("query_id", (-first["neg"]).alias("label"), first["sim"].alias("similarity"), (-second["neg"]).alias("second"), (first["sim"] - second["sim"]).alias("margin"))


def decision(found: DataFrame, similarity: float, margin: float, least_quality: float | None = None, spaces: DataFrame | None = None) -> DataFrame:
    """found with `decision`: match, or unknown; a null margin passes, unless a second identity should have been there.

    least_quality: found has `quality`, which must reach it where it isn't null.  spaces: (first, identities), how many identities
    the searched stage has, which found names in `first`; where there are two, a second one must have been found.
    """
    ok = (F.col("similarity") >= similarity) & F.coalesce(F.col("margin") >= margin, F.lit(True))
    if least_quality is not None:
        ok &= F.coalesce(F.col("quality") >= least_quality, F.lit(True))
    if spaces is not None:
        found = found.join(F.broadcast(spaces), "first", "left")  # two rows
        ok &= F.col("second").isNotNull() | (F.coalesce("identities", F.lit(0)) < 2)
    return found.withColumn("decision", F.when(F.coalesce(ok, F.lit(False)), "match").otherwise("unknown"))


def stage_identities(gallery: DataFrame, first: str, label: str = "label") -> DataFrame:
    """(first, identities): identities in the first stage's rows, and in all rows."""
    n = gallery.agg(F.countDistinct(F.when(F.col(first), F.col(label))).alias("a"), F.countDistinct(label).alias("b"))
    return n.select(F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("a").alias("identities")), F.struct(F.lit(False).alias("first"), F.col("b").alias("identities")))).alias("s")).select("s.*")


def mean_distance(near: DataFrame, ks: list[int]) -> DataFrame:
    """Mean distance to the first k neighbours for each k, from one ranked join."""
    return near.groupBy("query_id").agg(*(F.avg(F.when(F.col("rank") <= k, F.col("value"))).alias(f"knn_{k}") for k in ks))


@dataclass(frozen=True)
class Learner:
    """An identity's stored vectors, as it learns from confident matches.

    A candidate is learned if its similarity to the authoritative vectors (to all, where there are none) reaches `least`,
    `wait` seconds have passed since the last that was learned, and no stored vector is as near as `near`.  Beyond `cap` vectors the
    oldest that aren't authoritative are pruned, the learned one itself if there is no other.
    """

    least: float = 0.75
    wait: float = 60.0
    near: float = 0.98
    cap: int = 100

    def fresh(self) -> dict:
        return {"ids": [], "own": [], "units": None, "last": None}

    def step(self, state: dict, vec_id: int, at: float, v: np.ndarray, authoritative: bool, allowed: bool) -> tuple[dict, tuple[str, float | None, float | None, list[int]]]:
        """The next state and (outcome, similarity, similarity to the nearest stored vector, pruned ids)."""
        size = float(np.sqrt(v @ v))
        unit = v / size if size > 0 else np.zeros(len(v))
        if authoritative:
            return self._stored(state, vec_id, unit, True), ("enrolled", None, None, [])
        if not state["ids"]:
            return state, ("unknown", None, None, [])
        sims = state["units"] @ unit
        own = np.array(state["own"])
        best, nearest = float(sims[own].max() if own.any() else sims.max()), float(sims.max())
        if not allowed or best < self.least:
            return state, ("refused", best, nearest, [])
        if state["last"] is not None and at - state["last"] < self.wait:
            return state, ("cooldown", best, nearest, [])
        if nearest >= self.near:
            return state, ("duplicate", best, nearest, [])
        state = self._stored(state, vec_id, unit, False) | {"last": at}
        state, gone = self._pruned(state)
        return state, ("learned", best, nearest, gone)

    def _stored(self, state: dict, vec_id: int, unit: np.ndarray, own: bool) -> dict:
        units = unit[None] if state["units"] is None else np.concatenate([state["units"], unit[None]])
        return state | {"ids": [*state["ids"], vec_id], "own": [*state["own"], own], "units": units}

    def _pruned(self, state: dict) -> tuple[dict, list[int]]:
        oldest = [k for k, own in enumerate(state["own"]) if not own][: max(0, len(state["ids"]) - self.cap)]
        keep = [k for k in range(len(state["ids"])) if k not in oldest]
        gone = [state["ids"][k] for k in oldest]
        return state | {"ids": [state["ids"][k] for k in keep], "own": [state["own"][k] for k in keep], "units": state["units"][keep]}, gone


def learned(rows: DataFrame, learner: Learner, identity: str = "label", at: str = "at", key: str = "vec_id", vector: str = "v", authoritative: str = "authoritative", allowed: str = "allowed") -> DataFrame:
    """identity, id, outcome, similarity, nearest, pruned of each row: enrolled, unknown, refused, cooldown, duplicate or learned.

    Rows of an identity are taken in order of time, then id; what is learned counts for those after it.  The state is an
    identity's authoritative vectors and at most cap others.  An identity is one task's, as each outcome depends on those before
    it, but its rows are streamed, not gathered.  Rows without identity or vector are left out.
    """
    from watchplan.operators.windows import fold

    def step(state, row):
        _, now, vec_id, v, own, may = row
        state, (outcome, best, near, gone) = learner.step(state, int(vec_id), float(now), np.asarray(v, np.float64), bool(own), bool(may))
        return state, [row[0], vec_id, outcome, best, near, gone]

    some = rows.where(F.col(identity).isNotNull() & F.col(vector).isNotNull()).withColumn(authoritative, F.coalesce(authoritative, F.lit(False))).withColumn(allowed, F.coalesce(allowed, F.lit(False)))
    out = fold(some, [identity], [at, key], f"{identity} long, {key} long, outcome string, similarity double, nearest double, pruned array<long>", learner.fresh, step, [at, key, vector, authoritative, allowed])
    return out
