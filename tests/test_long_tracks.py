"""Peaks and even samples without a track gathered in one row."""

import re

from pyspark.sql import functions as F

from watchplan import catalog
from watchplan.operators import ranking as O
from watchplan.plans import views as V


def test_peaks_as_by_arrays(spark, small):
    by = ["user_id", "event_type"]
    rows = V.scores(spark, small).select((F.col("user_id") % 3).alias("user_id"), "event_type", "ts", "event_id", F.round("score").alias("score"))  # long tracks, many ties
    rows = rows.unionByName(spark.createDataFrame([(9, "up", k, float(x)) for k, x in enumerate((61, 62, 63, 62, 61, 0, 60))], "user_id long, event_type string, event_id long, score double").withColumn("ts", F.lit(None).cast("timestamp")))
    rows = rows.unionByName(rows.where("user_id = 9").withColumn("event_type", F.lit("low")).withColumn("score", F.lit(1.0)))
    lists = rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "score"))), lambda x: x["score"] - 60).alias("v"))
    want = {tuple(r)[:2]: list(r[2]) for r in lists.select(*by, O.peaks(F.col("v"), 4)).collect()}
    got = {tuple(r)[:2]: list(r[2]) for r in O.track_peaks(rows, by, ["ts", "event_id", "score"], F.col("score") - 60, 4, "user_id long, event_type string").collect()}
    assert got == want and got[9, "up"] == [2, 4, 0] and got[9, "low"] == []


def test_no_track_in_one_row(spark, small):
    for name in ("t10_peaks", "t12_even_sample"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" in plan and not re.search(r"collect_list\((event_id|struct\(ts)", plan)
