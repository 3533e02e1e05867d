"""A small rule table for the rule queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id, rule_type, event, place, text, severity, events, min_ratio, max_ratio, needs_evidence
_ROWS = [
    (1, "trigger", "loitering", "All", "Loitering near the entrance at night", "high", "pose,deep", 1.15, None, True),
    (2, "suppress", "loitering", "Lobby", "Guards may stand in the lobby", "low", "pose", None, 1.5, False),
    (3, "trigger", "running", "Lobby", "Running people in the lobby", "medium", "deep", 1.0, 3.0, False),
    (4, "other", "running", "lobby", "Running  people in the LOBBY", "medium", "deep", 1.0, 3.0, False),
    (5, "suppress", "other", "Garage", "Deliveries at the garage door", "low", "pose,deep,homography", None, None, False),
    (6, "trigger", "fighting", "Garage", "A fight at the garage", "critical", "pose", 1.5, None, True),
    (7, "trigger", "running", "Lobby", "running people in the lobby", "medium", "deep", 1.0, 3.0, False),
    (8, "suppress", "fighting", "All", "Training fights are allowed", "low", "pose", None, 2.0, False),
    (9, "trigger", "loitering", "Lobby", "Loitering in the lobby", "high", "pose", 1.2, 2.5, True),
]
_NAMES = ["id", "rule_type", "event", "place", "text", "severity", "gates", "min_ratio", "max_ratio", "needs_evidence"]


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_values('CAST(NULL AS DOUBLE)')} AS r({', '.join(_NAMES)})")


def _values(null: str) -> str:
    say = lambda v: null if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})"
    return ", ".join("(" + ", ".join(map(say, row)) + ")" for row in _ROWS)


SQL = f"SELECT * FROM (VALUES {_values('NULL')}) AS r({', '.join(_NAMES)})"
