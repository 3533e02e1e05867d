"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups that must stay together.

Every partial partition begins as one group in one part.  The two with the largest spread are
combined, the fullest part of one with the emptiest of the other, until one is left.  Groups are dealt
into buckets that tasks solve side by side; each bucket's result is a partial partition with a small
spread, and the same differencing over buckets gives the shards.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchplan.llm.common import broadcast_if_small, workspace, written

#: Groups of a bucket, about, and the most buckets, so that their combination stays one small task.
BUCKET_GROUPS, MOST_BUCKETS = 20_000, 50_000
#: Groups of more rows than this are few, and known everywhere, so that no join has all rows of one text in one task.
HEAVY_ROWS = 10_000


def difference(items: list[list[int]], parts: int) -> list[list[int]]:
    """For partial partitions (part sums each): of each, the part of the result that each of its parts goes to."""
    if not items:
        return []
    nodes: list[tuple] = []  # leaves: the order of their parts; inner nodes: children with their parts' places
    heap = []
    for k, sums in enumerate(items):
        order = sorted(range(parts), key=lambda j, s=sums: (-s[j], j))
        nodes.append((order,))
        own = [sums[j] for j in order]
        heap.append((own[-1] - own[0], k, own))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [x[j] + y[parts - 1 - j] for j in range(parts)]
        order = sorted(range(parts), key=lambda j, s=both: -s[j])
        nodes.append((a, b, order))
        own = [both[j] for j in order]
        heapq.heappush(heap, (own[-1] - own[0], len(nodes) - 1, own))
    out: list[list[int]] = [[] for _ in items]
    todo = [(heap[0][1], list(range(parts)))]
    while todo:
        k, goes = todo.pop()  # goes[j]: where the node's j-th part ends up
        if len(nodes[k]) == 1:
            out[k] = [0] * parts
            for j, part in enumerate(nodes[k][0]):
                out[k][part] = goes[j]
            continue
        a, b, order = nodes[k]
        of_a, of_b = [0] * parts, [0] * parts
        for j, part in enumerate(order):
            of_a[part] = of_b[parts - 1 - part] = goes[j]
        todo += [(a, of_a), (b, of_b)]
    return out


def shards(docs: DataFrame, parts: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; rows of equal texts share a shard.

    size: UTF-8 bytes plus 1.  Law `bytes`: shard sizes are as near equal as whole groups allow; a group
    larger than a share fills its shard alone.  Null texts have no bytes and are one group with empty
    ones; repeated rows have slots of their own; grown_shard is null, as this law is not by key.
    """
    folder, spark = workspace(docs.sparkSession), docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("sha"))
    rows = written(rows, folder, "rows")
    groups = written(rows.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), folder, "groups")
    buckets = min(MOST_BUCKETS, -(-groups.count() // BUCKET_GROUPS)) or 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "sha"], ascending=[False, True])
        goes = difference([[b] + [0] * (parts - 1) for b in pdf["bytes"].tolist()], parts)
        return pd.DataFrame({"sha": pdf["sha"], "bytes": pdf["bytes"], "n": pdf["n"], "bucket": pdf["bucket"], "part": [g[0] for g in goes]})

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int"))
    solved = written(dealt.groupBy("bucket").applyInPandas(solve, "sha string, bytes long, n long, bucket int, part int"), folder, "solved")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.pivot(index="bucket", columns="part", values="bytes").reindex(columns=range(parts)).fillna(0).astype("int64")
        goes = difference(sums.to_numpy().tolist(), parts)
        return pd.DataFrame([(b, p, g[p]) for b, g in zip(sums.index.tolist(), goes, strict=True) for p in range(parts)], columns=["bucket", "part", "shard"])

    partial = solved.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")).withColumn("one", F.lit(0))
    places = partial.groupBy("one").applyInPandas(lambda p: combine(p), "bucket int, part int, shard int")  # at most MOST_BUCKETS * parts rows
    of_group = written(solved.join(F.broadcast(places), ["bucket", "part"]).select("sha", "n", "shard"), folder, "shards")
    heavy = broadcast_if_small(of_group.where(F.col("n") > HEAVY_ROWS), 100)
    whole = rows.join(heavy, "sha").unionByName(rows.join(heavy.select("sha"), "sha", "left_anti").join(of_group.where(F.col("n") <= HEAVY_ROWS), "sha"))
    placed = written(whole.select("doc_id", "size", "text_crc32", "shard"), folder, "placed")
    # slots: rows are numbered in small chunks of a shard, and chunks begin where those before them end
    chunks = max(1, rows.count() // (parts * 1000))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).cast("int"))
    sums = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = broadcast_if_small(sums.select("shard", "chunk", before.alias("begin")), 40, chunks * parts)
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("number", number).join(begin, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
