"""Differencing against a plain version, near-equal bytes, and groups of many rows."""

import random

import pytest
from pyspark.sql import functions as F

from watchplan.llm import sharding


def plain_difference(sizes, parts):
    """Sums of the parts, by lists that are sorted again at each step."""
    own = [sorted([s] + [0] * (parts - 1), reverse=True) for s in sizes]
    while len(own) > 1:
        own.sort(key=lambda x: x[0] - x[-1])
        a, b = own.pop(), own.pop()
        own.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return own[0]


@pytest.mark.parametrize("parts", [2, 3, 16])
def test_as_a_plain_version(parts):
    r = random.Random(parts)
    for n in (1, 2, 5, 17, 200):
        sizes = r.sample(range(1, 10**9), n)
        goes = [g[0] for g in sharding.difference([[s] + [0] * (parts - 1) for s in sizes], parts)]
        assert sorted((sum(s for s, g in zip(sizes, goes, strict=True) if g == k) for k in range(parts)), reverse=True) == plain_difference(sizes, parts)


def test_bytes_nearly_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 300)  # several buckets, combined
    monkeypatch.setattr(sharding, "HEAVY_ROWS", 50)
    r = random.Random(9)
    rows = [(k, "x" * r.randrange(1, 400)) for k in range(3000)] + [(3000 + k, "the same text") for k in range(700)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 16).cache()
    sizes = [x["s"] for x in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert (len(sizes), got.count()) == (16, 3700)
    assert max(sizes) - min(sizes) <= 64, sizes  # of 38,700 bytes each; a dozen small buckets
    assert got.where("text_crc32 = crc32(cast('the same text' as binary))").select("shard").distinct().count() == 1
    assert all(x["n"] == x["m"] + 1 for x in got.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m")).collect())
    got.unpersist()
