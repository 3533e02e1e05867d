"""What the driver builds for broadcasts stays a small part of its heap."""

from watchplan.llm import common


def test_large_sides_are_shuffled_whatever_their_files_weigh(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("id as node", "id div 7 as root")  # a few MB of files, 12.8 MB of rows: was broadcast
    side = common.written(rows, str(tmp_path), "side")
    joined = spark.range(100).withColumnRenamed("id", "root").join(common.broadcast_if_small(side, 32), "root")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    small = common.broadcast_if_small(side.limit(10), 32)
    assert "BroadcastHashJoin" in spark.range(100).withColumnRenamed("id", "root").join(small, "root")._jdf.queryExecution().executedPlan().toString()
