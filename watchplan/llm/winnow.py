"""Document fingerprints by winnowing.

All k-grams of code points have a rolling (polynomial) hash; of each window of w
hashes the least is chosen, the rightmost of equals, and its position is kept.  Two texts that share
k + w - 1 code points in a row therefore share a fingerprint entry.  By default k and w follow from a text's
length n, such that a shared half of n, rounded up, is enough even for short texts (see densities).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import texts

#: Any run of GRAM + WINDOW - 1 = 79 shared code points shares an entry; the widest window (see densities).
GRAM, WINDOW = 16, 64


def densities(n: int) -> list[tuple[int, int]]:
    """(gram, window) of a text of n code points, half = n / 2 rounded up.

    From 157 code points on GRAM and WINDOW; from 31 on GRAM and a window of half - 15, so that gram + window - 1 is
    half.  A shorter text has all grams of p and of 2 p code points, p being the greatest power of 2 up to half.  Windows
    of different widths agree, as what is least in the wider one is so in the narrower; and texts of n and of half to n
    code points always have a size of gram in common that half of n holds.  So they share an entry if they share half
    of the longer, or GRAM + WINDOW - 1, code points in a row.
    """
    half = (n + 1) // 2
    if half >= GRAM:
        return [(GRAM, min(WINDOW, half - GRAM + 1))]
    p = 1 << max(0, half.bit_length() - 1)
    return [(g, 1) for g in (p, 2 * p) if g <= max(1, n)]


def fingerprint(text: str, gram: int | None = None, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen in text, in order, by the densities of its length unless gram and window are given.

    A text shorter than a given gram is one gram; an empty one has none.
    """
    if gram is None and window is None:
        parts = [_chosen(text, g, w) for g, w in densities(len(text))]
        if len(parts) == 1:
            return parts[0]
        h, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(p, kind="stable")
        return h[order], p[order]
    return _chosen(text, gram or GRAM, window or WINDOW)


#: The base of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0, ..., base**(n - 1) modulo 2**64; kept up to a million, so that not each text makes them anew."""
    own = _powers.get(base)
    if own is None or own.size < n:
        own = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096) - 1, base, np.uint64))])
        if n <= 1 << 20:
            _powers[base] = own
    return own[:n]


def rolling(points: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams: sum of mixed code point m times BASE**m, modulo 2**64.

    One step to the right, (h - first) / BASE + next * BASE**(gram - 1), is done for all places at once as a
    difference of running sums.
    """
    mixed = _mix(points.astype(np.uint64) + np.uint64(1))
    n = mixed.size
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _power(BASE, n), dtype=np.uint64)])
    return (sums[gram:] - sums[:-gram]) * _power(_INVERSE, n)[: n - gram + 1]


def _chosen(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not points.size:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    want = min(gram, points.size)
    hashes = _mix(rolling(points, want) + np.uint64(want)) >> np.uint64(32)
    n = hashes.size
    # the greater the place, the less the key: of equal hashes the rightmost is least
    key = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    span = min(window, n)
    low, size = key, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: n - span + 1], low[span - size :])
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sets of hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if a.size or b.size else 1.0


def as_string(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Entries hash@position, hash in hex, joined by blanks."""
    return " ".join([f"{h:x}@{p}" for h, p in zip(print_[0].tolist(), print_[1].tolist(), strict=True)])


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by as many first ones (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, doc_id (0 where null), no_id, text, own: rows such that, within a bucket and in order, each own row is followed by the next document.

    The order is doc_id, then a hash of the text, then the text; rows without doc_id come last, by hash.  Buckets
    are ranges of doc_id between quantiles; an id that fills several ranges, and rows without one, are
    cut by the hash, so that no id's rows make one bucket.  The first row of each bucket is sent to the bucket before it
    as well (own false), the very first one to the last.  So the texts move once and no task needs the
    whole order.  Only the buckets' bounds and least ids, bounded by the number of buckets, reach the driver.
    """
    spark = docs.sparkSession
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text", F.xxhash64("text").alias("h"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = texts(docs).where("doc_id is not null")
    bounds = np.array(sorted(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)), np.float64)
    share = rows.agg(F.avg(F.col("no_id").cast("double"))).first()[0] or 0.0
    without = max(1, round(n * share))

    def number(doc_id: pd.Series, no_id: pd.Series, h: pd.Series) -> np.ndarray:
        v = doc_id.to_numpy(np.float64)
        part = (h.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        low, high = np.searchsorted(bounds, v, "left"), np.searchsorted(bounds, v, "right")
        cut = np.minimum(low + 1 + np.floor(part * (high - low)), high)
        own = np.where(high > low, cut, high)
        return np.where(no_id.to_numpy(bool), bounds.size + 1 + np.minimum(np.floor(part * without), without - 1), own).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(doc_id: pd.Series, no_id: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(number(doc_id, no_id, h).astype(np.int32))

    firsts = rows.select("doc_id", "no_id", "h").withColumn("bucket", bucket("doc_id", "no_id", "h")).groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("first")).orderBy("bucket").collect()
    kept = [r["bucket"] for r in firsts]
    least = {(r["bucket"], r["first"]["doc_id"], r["first"]["h"]): kept[k - 1] for k, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def buckets(doc_id: pd.Series, no_id: pd.Series, h: pd.Series) -> pd.Series:
        own = number(doc_id, no_id, h).tolist()
        before = [least.get(x) for x in zip(own, doc_id.tolist(), h.tolist(), strict=True)]
        return pd.Series([[b] if f is None else [b, f] for b, f in zip(own, before, strict=True)])

    placed = rows.withColumn("at", buckets("doc_id", "no_id", "h")).select("doc_id", "no_id", "text", "h", F.posexplode("at").alias("k", "bucket"))
    # the copy of the first document of a bucket closes the bucket before it
    own = (F.col("k") == 0).alias("own")
    return placed.select("bucket", "doc_id", "no_id", "text", "h", own).repartition(n // 4, "bucket").sortWithinPartitions("bucket", F.col("own").desc(), "doc_id", "h", "text").drop("h")


def fingerprints(docs: DataFrame, gram: int | None = None, window: int | None = None) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how like the edited and the next text are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts
    count as empty; rows without doc_id come last and rows that repeat a doc_id next to each other, in a fixed order by
    text.  A task streams through its buckets and holds two texts at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            out = []
            for row in zip(pdf["bucket"].tolist(), pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"], pdf["own"].tolist(), strict=True):
                if held is not None and held[0][0] != row[0]:
                    raise RuntimeError("a bucket without its following document")
                now = (row, fingerprint(row[3], gram, window))
                if held is not None:
                    (_, doc_id, no_id, text, _), print_ = held
                    changed = edited(text, row[3])
                    other = fingerprint(changed, gram, window)
                    out.append((None if no_id else doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_string(print_), as_string(other), likeness(print_[0], other[0]), likeness(print_[0], now[1][0])))
                held = now if row[4] else None
            if out:
                frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                frame["doc_id"] = pd.array([r[0] for r in out], "Int64")
                yield frame

    return with_next(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
