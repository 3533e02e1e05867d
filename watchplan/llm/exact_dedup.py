"""Exact dedup by a log-structured merge index over text digests.

Each task fills a memtable, comparing bytes when a digest is met again, and flushes it as a sorted
run of digests, cut into segments, each with a filter.  Compaction goes in levels: FAN runs of a level become
one of the next, segment by segment, and each segment is cut into FAN as it grows by FAN, so that what a
task holds at once never grows with the corpus.  Filters tell which digests another of the FAN runs may
hold; only those are merged, keeping one identifier, the others go on as they are.  Digests that several runs
did hold are hits, whose texts are then compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchplan.llm.common import broadcast_if_small, join_groups, texts, workspace, written

#: A memtable is flushed beyond so many bytes of text or rows.
MEMTABLE_BYTES, MEMTABLE_ROWS = 48 << 20, 400_000
#: Runs that one compaction merges, and segments of a run at least: a task holds at most about FAN * MEMTABLE_ROWS / SEGMENTS keys.
FAN, SEGMENTS = 16, 16
_FILTER_BITS, _FILTER_HASHES = 12, 3
_RUN = "kind int, doc_id long, rid long, sha string, best_id long, best_rid long, n long, segment long, run long, keys binary, filter binary, bests binary"
_ROW = np.dtype([("id", "<i8"), ("rid", "<i8"), ("n", "<i8"), ("runs", "<i8")])
_NO_ID = -(1 << 63)


def _filter(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places that the keys (rows of bytes) set in a filter of so many bits."""
    h = np.ascontiguousarray(keys[:, :16]).view("<u8")
    return np.stack([(h[:, 0] + np.uint64(k) * h[:, 1]) % np.uint64(bits) for k in range(_FILTER_HASHES)], 1).astype(np.int64)


def _pair(doc_id: int | None, rid: int, smallest: bool) -> tuple[int, int]:
    """Sorts so that the greater stays: null ids lose; of equal ids the first row stays."""
    return (_NO_ID if doc_id is None else -doc_id if smallest else doc_id, -rid)


def _packed_filter(keys: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, np.uint8)
    out[_filter(keys, bits).ravel()] = 1
    return np.packbits(out).tobytes()


def _memtables(batches: Iterator[pd.DataFrame], segments: int, key_bytes: int, smallest: bool, bits: int, most_rows: int) -> Iterator[pd.DataFrame]:
    task = TaskContext.get().partitionId()
    rid, run = task << 33, task << 20
    table: dict[bytes, list[list]] = {}
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal size, run
        rows = [(0, i, r, sha, e[1], e[2], e[3], None, None, None, None, None) for i, r, sha, e in held]
        by: dict[int, list[bytes]] = {}
        for k in sorted(table):
            by.setdefault(int.from_bytes(k[:4], "big") % segments, []).append(k)
        for segment, own in by.items():
            best = np.zeros(len(own), _ROW)
            for at, k in enumerate(own):
                top = max(table[k], key=lambda e: e[0])
                best[at] = (_NO_ID if top[1] is None else top[1], top[2], sum(e[3] for e in table[k]), 1)
            blob = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), 32)
            rows.append((1, None, None, None, None, None, None, segment, run, blob.tobytes(), _packed_filter(blob, bits), best.tobytes()))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _RUN.split(", ")])
        for c in ("doc_id", "rid", "best_id", "best_rid", "n", "segment", "run"):
            frame[c] = frame[c].astype("Int64")
        table.clear()
        held.clear()
        size, run = 0, run + 1
        yield frame

    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            data = text.encode()
            digest = hashlib.sha256(data)
            key = (digest.digest() if key_bytes >= 32 else digest.digest()[:key_bytes]).ljust(32, b"\0")
            entries = table.setdefault(key, [])
            order = _pair(doc_id, rid, smallest)
            entry = next((e for e in entries if e[4] == data), None)  # the hit's bytes are compared
            if entry is None:
                entry = [order, doc_id, rid, 0, data]
                entries.append(entry)
                size += len(data)
            elif order > entry[0]:
                entry[:3] = order, doc_id, rid
            entry[3] += 1
            held.append((doc_id, rid, digest.hexdigest(), entry))
            rid += 1
            if size >= MEMTABLE_BYTES or len(held) >= most_rows:
                yield from flush()
    if held:
        yield from flush()


def merged(runs: list[tuple[bytes, bytes, bytes]], smallest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their entries, of one segment of some runs given as (keys, filter, entries) packed."""
    count = sum(np.unpackbits(np.frombuffer(f, np.uint8)) for _, f, _ in runs)  # at most FAN
    keys = np.concatenate([np.frombuffer(k, np.uint8).reshape(-1, 32) for k, _, _ in runs])
    best = np.concatenate([np.frombuffer(b, _ROW) for _, _, b in runs])
    maybe = (count[_filter(keys, count.size)] >= 2).all(1)  # another run's filter has it too
    alone_k, alone_b, keys, best = keys[~maybe], best[~maybe], keys[maybe], best[maybe]
    if len(keys):
        values, inverse, counts = np.unique(np.ascontiguousarray(keys).view("V32").ravel(), return_inverse=True, return_counts=True)
        ids = np.where(best["id"] == _NO_ID, np.iinfo(np.int64).max if smallest else _NO_ID, best["id"])
        order = np.lexsort((best["rid"] if smallest else -best["rid"], ids, inverse))
        last = np.cumsum(counts) - 1
        top = best[order[last - counts + 1 if smallest else last]].copy()
        for c in ("n", "runs"):
            top[c] = np.round(np.bincount(inverse, best[c])).astype(np.int64)
        keys, best = values.view(np.uint8).reshape(-1, 32), top
    keys, best = np.concatenate([alone_k, keys]), np.concatenate([alone_b, best])
    order = np.argsort(np.ascontiguousarray(keys).view("V32").ravel(), kind="stable")
    return keys[order], best[order]


def compacted(runs: DataFrame, level: int, smallest: bool, bits: int, fan: int = FAN) -> DataFrame:
    """(segment, run, keys, filter, bests) of the next level: fan runs, which are numbered 0, 1, ..., become one, a segment becomes fan."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.withColumn("group", F.floor(F.col("run") / fan)).repartition(n, "group", "segment").sortWithinPartitions("group", "segment", "run").select("group", "segment", "keys", "filter", "bests")

    def of(key: tuple, held: list[tuple[bytes, bytes, bytes]]) -> list[tuple]:
        keys, best = merged(held, smallest)
        sub = keys[:, 4 + level].astype(np.int64) % fan
        return [(key[1] * fan + s, key[0], keys[sub == s].tobytes(), _packed_filter(keys[sub == s], bits), best[sub == s].tobytes()) for s in np.unique(sub).tolist()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, key, held = ["segment", "run", "keys", "filter", "bests"], None, []
        for pdf in batches:
            out = []
            for group, segment, keys, own, bests in pdf.itertuples(index=False, name=None):
                if held and (group, segment) != key:
                    out += of(key, held)
                    held = []
                key = (group, segment)
                held.append((keys, own, bests))
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(of(key, held), columns=names)

    return dealt.mapInPandas(run, "segment long, run long, keys binary, filter binary, bests binary")


def hits_of(runs: DataFrame, folder: str, smallest: bool, bits: int, fan: int = FAN) -> DataFrame:
    """(key, best_id, best_rid, n) of the digests that at least two of the runs (segment, run, keys, filter, bests) hold."""
    found = written(runs.select("run").distinct(), folder, "run-ids")  # a row for each flush of a memtable
    number = found.count()
    names = broadcast_if_small(found.select("run", (F.row_number().over(Window.orderBy("run")) - 1).cast("long").alias("number")), 32, number)
    table, level = runs.join(names, "run").select("segment", F.col("number").alias("run"), "keys", "filter", "bests"), 0
    while number > 1:
        table = written(compacted(table, level, smallest, bits, fan), folder, f"level-{level + 1}")
        number, level = -(-number // fan), level + 1

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, bests in zip(pdf["keys"], pdf["bests"], strict=True):
                best = np.frombuffer(bests, _ROW)
                hit = np.flatnonzero(best["runs"] >= 2)
                ids = best["id"][hit]
                yield pd.DataFrame({"key": pd.Series([keys[32 * k : 32 * k + 32].hex() for k in hit.tolist()], dtype=object), "best_id": pd.arrays.IntegerArray(ids.copy(), ids == _NO_ID), "best_rid": best["rid"][hit], "n": best["n"][hit]})

    return table.select("keys", "bests").mapInPandas(several, "key string, best_id long, best_rid long, n long")


def exact_groups(docs: DataFrame, keep: str = "largest", key_bits: int = 256, memtable_rows: int = MEMTABLE_ROWS, fan: int = FAN) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; exactly one row of equal texts is kept.

    Of equal texts the row with the largest (keep="smallest": smallest) doc_id stays, of equal ids
    the first read; rows without doc_id stay only among themselves.  Null texts count as empty, and
    empty texts are equal.  key_bits below 256 shortens the index keys, so that different texts
    share them; the byte comparison then still tells them apart.  memtable_rows and fan: when a memtable is
    flushed at the latest, and how many runs one compaction merges.

    Texts leave a task only where their digest is a hit; then equal texts of a task are one row
    before they are shuffled.  Hits are broadcast if few, else joined.
    """
    spark, smallest, key_bytes = docs.sparkSession, keep == "smallest", key_bits // 8
    folder, rows = workspace(spark), texts(docs)
    segments = max(SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a block, one segment of one run, has some thousands of rows at least in all segments together, at every level
    bits = 1 << max(6, (_FILTER_BITS * MEMTABLE_ROWS // 16 // segments).bit_length())
    runs = written(rows.mapInPandas(lambda b: _memtables(b, segments, key_bytes, smallest, bits, memtable_rows), _RUN), folder, "runs")
    hits = written(hits_of(runs.where("kind = 1").select("segment", "run", "keys", "filter", "bests"), folder, smallest, bits, fan), folder, "hits")
    held = runs.where("kind = 0").select("doc_id", "rid", "sha", "best_id", "best_rid", "n").withColumn("key", _key("sha", key_bytes))
    # byte verification of hits: one row for each digest and text, summed within a task first
    keyed = rows.withColumn("key", _key(F.sha2(F.col("text").cast("binary"), 256), key_bytes))
    seen = join_groups(keyed, hits.select("key", F.col("n").alias("_n")), "key", 150).groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))
    variants = written(seen.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")), folder, "variants")
    good = hits.select("key", F.col("best_id").alias("top_id"), F.col("best_rid").alias("top_rid"), F.col("n").alias("total"), F.col("n").alias("_n")).join(variants.where("texts = 1").select("key"), "key")
    good = written(good, folder, "good")
    mixed = variants.where("texts > 1").select("key")
    if not mixed.isEmpty():
        held = _told_apart(rows, held, mixed, folder, smallest, key_bytes)
    joined = join_groups(held, good, "key", 150, "left")
    return joined.select(
        "doc_id",
        F.when(F.col("total").isNull(), F.col("best_id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        (F.col("rid") == F.coalesce("top_rid", "best_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _key(sha, key_bytes: int):
    sha = F.col(sha) if isinstance(sha, str) else sha
    return sha if key_bytes >= 32 else F.rpad(F.substring(sha, 1, 2 * key_bytes), 64, "0")


def _told_apart(rows: DataFrame, held: DataFrame, mixed: DataFrame, folder: str, smallest: bool, key_bytes: int) -> DataFrame:
    """held with its groups made anew, by text, for keys that stand for several texts."""
    sign = F.lit(-1 if smallest else 1)
    shared = held.join(mixed, "key", "left_semi")
    # the full digest of each (key, text); a group of several texts even so is split by the text itself
    named = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("key", _key("sha", key_bytes)).join(mixed, "key", "left_semi")
    twice = named.groupBy("sha", "text").count().groupBy("sha").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("two different texts with one SHA-256 digest")
    order = F.struct((F.coalesce(F.col("doc_id"), F.lit(None).cast("long")) * sign).alias("o"), (-F.col("rid")).alias("r"), "doc_id", "rid")
    tops = shared.groupBy("sha").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("m"))
    anew = shared.drop("best_id", "best_rid", "n").join(tops, "sha").select("doc_id", "rid", "sha", F.col("top.doc_id").alias("best_id"), F.col("top.rid").alias("best_rid"), F.col("m").alias("n"), "key")
    return written(held.join(mixed, "key", "left_anti").unionByName(anew), folder, "held")


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs with one row of each text, all columns kept; rows that repeat a doc_id and its text are copies too."""
    gone = exact_groups(docs, keep).where("not kept").select("doc_id", F.col("text_sha256").alias("gone_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same"))
    gone = written(gone, workspace(docs.sparkSession), "gone")
    ids = gone.where("not same").select(F.col("doc_id").alias("gone_id"), "gone_sha").distinct()
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    left = docs.join(broadcast_if_small(ids, 150), docs["doc_id"].eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha")), "left_anti")
    return left if gone.where("same").isEmpty() else left.dropDuplicates(["doc_id", "text"])
