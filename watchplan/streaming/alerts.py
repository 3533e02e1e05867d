"""Frequency alerts: more than a threshold of events per camera in a sliding window, by rules that may change.

Watermarks are an addition here: late rows beyond them don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.operators.joins import small

#: Rules of all cameras, where the cameras aren't given.
MOST_RULES = 1000


def windowed(events: DataFrame, ts: str, by: str, length: str, slide: str, late: str) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    n = events.groupBy(F.window(ts, length, slide), by).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    return n.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "last_ts")


def frequency_alerts(events: DataFrame, rules: DataFrame, ts: str = "ts", by: str = "camera_id", length: str = "60 seconds", slide: str = "30 seconds", late: str = "2 minutes", cameras: DataFrame | None = None) -> DataFrame:
    """Windows with more events than a rule of the camera (or of all, camera null) allows.

    rules: (rule_id, camera_id, threshold).  They are the static side of the join and read anew in each
    batch, so a changed table counts from the next batch on.
    """
    w = windowed(events, ts, by, length, slide, late)
    own = rules.where(F.col(by).isNotNull()).select("rule_id", F.col(by).alias("_c"), "threshold")
    every = rules.where(F.col(by).isNull()).select("rule_id", "threshold")
    out = w.join(small(own), w[by] == own["_c"]).drop("_c").select(*w.columns, "rule_id", "threshold")
    # a rule of all cameras becomes one for each of them, so that no key has all windows; where cameras aren't given, rules are at most MOST_RULES
    if cameras is not None:
        named = every.crossJoin(F.broadcast(cameras.select(F.col(by).alias("_c"))))  # rules are few, cameras a dimension
        out = out.unionByName(w.join(small(named), w[by] == named["_c"]).drop("_c").select(*w.columns, "rule_id", "threshold"))
    else:
        listed = every.groupBy().agg(F.slice(F.collect_list(F.struct("rule_id", "threshold")), 1, MOST_RULES + 1).alias("_rules"))
        checked = listed.select(F.when(F.size("_rules") > MOST_RULES, F.raise_error(F.lit(f"more than {MOST_RULES} rules of all cameras: name the cameras"))).otherwise(F.col("_rules")).alias("_rules"))
        wide = w.crossJoin(F.broadcast(checked)).select(*w.columns, F.explode("_rules").alias("_r"))  # one row
        out = out.unionByName(wide.select(*w.columns, "_r.rule_id", "_r.threshold"))
    return out.where(F.col("n") > F.col("threshold")).withColumn("text", F.format_string("camera %s: %d events (threshold: %d)", F.col(by).cast("string"), "n", "threshold"))


def suppressed(alerts: DataFrame, by: list[str], at: str, gap_seconds: float) -> DataFrame:
    """In a batch of alerts, those at least gap_seconds after the last one that was let through."""
    from watchplan.operators.windows import fold

    def step(last, row):
        now = row[-1]
        return (now, list(row)) if last is None or now - last >= gap_seconds else (last, None)

    kinds = dict(alerts.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "second double"])
    rows = alerts.withColumn("second", F.unix_micros(F.col(at)) / 1e6)
    return fold(rows, by, ["second"], schema, lambda: None, step, ["second"])
