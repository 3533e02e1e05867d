"""Calibration: mixture models, information criteria, robust scaling, principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchplan.operators.quantiles import percentiles
from watchplan.sources.shared import folder, written


@dataclass
class Mixture:
    """A full-covariance Gaussian mixture: a few small arrays."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Natural log of each component's weighted density of each row of x, (components, rows)."""
        parts = []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            low = np.linalg.cholesky(c)
            z = np.linalg.inv(low) @ (x - m).T
            parts.append(np.log(w) - 0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(m) * np.log(2 * np.pi))
        return np.stack(parts)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Natural log of the density of each row of x (log-sum-exp over components)."""
        p = self.log_parts(x)
        top = p.max(0)
        return top + np.log(np.exp(p - top).sum(0))

    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2


def fit_mixture(df: DataFrame, columns: list[str], k: int, rounds: int | None = None, reg: float = 1e-6, tolerance: float = 1e-6, seed: int = 42) -> tuple[Mixture, float]:
    """A mixture of k components and its mean log-likelihood, as fit_mixtures makes them."""
    return fit_mixtures(df, columns, [k], rounds, reg, tolerance, seed)[0]


def fit_mixtures(df: DataFrame, columns: list[str], ks: Sequence[int], rounds: int | None = None, reg: float = 1e-6, tolerance: float = 1e-6, seed: int = 42) -> list[tuple[Mixture, float]]:
    """For each k a mixture and its mean log-likelihood, by expectation maximisation, until a round adds less than `tolerance` to that mean.

    `rounds`, if given, ends all fits earlier.  Each starts from k different rows chosen by a seeded hash.  Equal rows are one row with a weight; a round is
    one distributed pass over them for all fits that go on, whose tasks return sums of k x d x d numbers.  Rows with a feature that is null or not finite are left out.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().where(reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in columns]))
    rows = written(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_w")), f"{folder(df.sparkSession)}/points")
    first = rows.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(max(ks)).select(*columns).toPandas().to_numpy()
    if not len(first):
        raise ValueError("a mixture needs rows")
    mean = lambda x: F.sum(x * F.col("_w")) / F.sum("_w")
    centre = np.array(rows.agg(*(mean(F.col(c)) for c in columns)).first(), float)
    spread = rows.agg(*(mean((F.col(c) - float(m)) ** 2) for c, m in zip(columns, centre, strict=True))).first()
    start = np.diag([max(v, reg) for v in spread])
    # around the centre, so that squares don't cancel; fewer different rows than components are taken again
    models = [Mixture(np.full(k, 1 / k), first[np.arange(k) % len(first)] - centre, np.repeat(start[None], k, 0)) for k in ks]
    found, going, d, done = [-np.inf] * len(ks), set(range(len(ks))), len(columns), 0
    schema = "fit int, c int, n double, ll double, s array<double>, ss array<double>"
    while going and (rounds is None or done < rounds):
        shared = {f: models[f] for f in sorted(going)}

        def sums(batches: Iterator[pd.DataFrame], shared: dict[int, Mixture] = shared) -> Iterator[pd.DataFrame]:
            held = {f: [np.zeros(len(m.weights)), np.zeros((len(m.weights), d)), np.zeros((len(m.weights), d * d)), 0.0] for f, m in shared.items()}
            for pdf in batches:
                x, w = pdf[columns].to_numpy(float) - centre, pdf["_w"].to_numpy(float)
                if not len(x):
                    continue
                squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                for f, m in shared.items():
                    each = m.log_parts(x)
                    top = each.max(0)
                    r = np.exp(each - top)
                    total = r.sum(0)
                    r *= w / total
                    for k, more in enumerate((r.sum(1), r @ x, r @ squares, ((top + np.log(total)) * w).sum())):
                        held[f][k] += more
            for f, (n, s, ss, ll) in held.items():
                yield pd.DataFrame({"fit": f, "c": range(len(n)), "n": n, "ll": ll / len(n), "s": list(s), "ss": list(ss)})

        got = rows.mapInPandas(sums, schema)
        got = got.groupBy("fit", "c").agg(F.sum("n"), F.sum("ll"), *(F.sum(F.col("s")[i]) for i in range(d)), *(F.sum(F.col("ss")[i]) for i in range(d * d))).collect()
        for f in shared:
            a = np.array(sorted(list(r)[1:] for r in got if r["fit"] == f), float)[:, 1:]
            n, ll, s, ss = a[:, 0], a[:, 1].sum(), a[:, 2 : 2 + d], a[:, 2 + d :].reshape(-1, d, d)
            safe = np.maximum(n, 1e-12)
            means = s / safe[:, None]
            cov = ss / safe[:, None, None] - means[:, :, None] * means[:, None, :] + reg * np.eye(d)
            before, found[f] = found[f], ll / n.sum()
            models[f] = Mixture(safe / safe.sum(), means, cov)
            if not found[f] - before >= tolerance:
                going.discard(f)
        done += 1
    return [(Mixture(m.weights, m.means + centre, m.covariances), ll) for m, ll in zip(models, found, strict=True)]


def negative_log_likelihood(df: DataFrame, columns: list[str], model: Mixture) -> DataFrame:
    """df with `nll`, the anomaly score of each row under the mixture; null where a feature is."""

    def score(*xs: pd.Series) -> pd.Series:
        x = np.stack([s.to_numpy(float) for s in xs], 1)
        good = np.isfinite(x).all(1)
        out = np.full(len(x), np.nan)
        if good.any():
            out[good] = -model.log_density(x[good])
        return pd.Series(out)

    return df.withColumn("nll", F.pandas_udf(score, "double")(*columns)).withColumn("nll", F.when(~F.isnan("nll"), F.col("nll")))


def bic(mean_ll: float, rows: int, parameters: int) -> float:
    return float(parameters * np.log(rows) - 2 * mean_ll * rows)


def aic(mean_ll: float, rows: int, parameters: int) -> float:
    return float(2 * parameters - 2 * mean_ll * rows)


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range with exact percentiles; without a range, x - median."""
    found = []
    for c in columns:
        quartiles = F.array(*(F.max(F.when(F.col("point") == p, F.col("threshold"))) for p in (25.0, 50.0, 75.0)))
        found.append(percentiles(df, [], c, [25.0, 50.0, 75.0]).agg(quartiles.alias(f"_{c}")))
    out = df.crossJoin(F.broadcast(reduce(lambda a, b: a.crossJoin(b), found)))  # one row
    for c in columns:
        width = F.col(f"_{c}")[2] - F.col(f"_{c}")[0]
        out = out.withColumn(c, (F.col(c) - F.col(f"_{c}")[1]) / F.when(width > 0, width).otherwise(1.0))
    return out.drop(*(f"_{c}" for c in columns))


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, components, variances): sums of products in one pass, a d x d eigenproblem on the driver."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    r = df.agg(*(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).first()
    cov = np.zeros((d, d))
    for n, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = r[d + n]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    comp = vectors[:, order].T
    sign = np.sign(comp[np.arange(len(order)), np.abs(comp).argmax(1)])
    return np.array(list(r)[:d]), comp * sign[:, None], values[order]


def projected(df: DataFrame, columns: list[str], means: np.ndarray, components: np.ndarray) -> DataFrame:
    sums = [sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, means, comp, strict=True)), F.lit(0.0)) for comp in components]
    return df.withColumns({f"pc{k + 1}": s for k, s in enumerate(sums)})


def hits(score: Column, threshold: Column) -> Column:
    return F.coalesce(score > threshold, F.lit(False))


def homographies(points: DataFrame, by: str, image: tuple[str, str], world: tuple[str, str], ransac: float, order: str, least: int = 4) -> DataFrame:
    """by, h (nine numbers by row), pairs, inliers, mean, median, max of the residuals over all pairs: one homography for each group.

    A group is the pairs of one calibration, a handful; groups below `least` pairs have none, nor have those in which no four pairs agree.
    """
    from watchplan.functions.geometry import agreeing, fitted

    row = F.struct(order, *(F.col(c).cast("double").alias(n) for c, n in zip((*image, *world), "xyuv", strict=True)))
    held = points.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("p")).where(F.size("p") >= max(4, least))
    flat = held.select(by, *(F.col(f"p.{n}").alias(n) for n in "xyuv"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, own in pdf.groupby(pdf["x"].map(len)):  # groups of one size are one array
                x, y, u, v = (np.stack(own[c].to_list()).astype(float) for c in "xyuv")
                a, b = np.stack([x, y], -1), np.stack([u, v], -1)
                inside = agreeing(a, b, ransac)
                some = inside.sum(1) >= 4  # else no four pairs agree
                h, off = fitted(a[some], b[some], inside[some])
                yield pd.DataFrame({by: own[by][some], "h": list(h.reshape(-1, 9)), "pairs": n, "inliers": (off <= ransac).sum(1), "mean": off.mean(1), "median": np.median(off, 1), "max": off.max(1)})

    kind = points.schema[by].dataType.simpleString()
    return flat.mapInPandas(run, f"{by} {kind}, h array<double>, pairs long, inliers long, mean double, median double, max double")
