"""Rules meet in blocks; their pairs are written in runs."""

from test_rule_conflicts import _conflicts

from watchplan.operators import joins as J


def _few_kinds(spark, n):
    rows = [(7 * k % (n + 1), ("trigger", "suppress", "other")[k % 3], ("running", "other")[k % 5 == 0], ("Gate", " gate ", "All", None)[(0, 1, 0, 1, 2, 0, 3)[k % 7]]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, rule_type string, event string, place string").repartition(3)


def test_kinds_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BITS", 2)  # four rules
    rows, df = _few_kinds(spark, 300)
    assert sorted(map(tuple, J.conflicting_rules(df).collect())) == _conflicts(rows)


def test_written_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    n = 3000
    df = spark.range(n).selectExpr("id", "if(id % 2 = 0, 'trigger', 'suppress') AS rule_type", "'theft' AS event", "'Gate' AS place")
    J.conflicting_rules(df).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == n * n // 4
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.5 * n * n / 4, size / (n * n / 4)
