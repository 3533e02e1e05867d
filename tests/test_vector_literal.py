"""Vectors as text."""

import numpy as np
from pyspark.sql import functions as F

from watchplan.functions import text as T


def test_literal_is_that_of_printf(spark):
    rng = np.random.default_rng(1)
    v = [*(float(x) for x in rng.normal(size=3000).astype(np.float32)), 0.5**9, 3 * 0.5**9, 1.000000005, 0.000000015, -0.0, -1e-12, 1234567.25, 1e17, float("nan"), float("inf"), float("-inf")]
    got = spark.createDataFrame([(v,)], "v array<double>").select(T.vector_literal(F.col("v"), 8)).first()[0]
    assert got == "[" + ",".join(f"{x:.8f}" for x in v) + "]"
