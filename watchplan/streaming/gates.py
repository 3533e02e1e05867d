"""Live gates per track with arbitrary state: smoothing, N-of-M persistence, rising edge, cooldown, expiry.

The same step function runs as a fold over a table (the batch twin) and, with its state kept by the
engine, over a stream.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TUBELETS = "track string, seq long, scores array<double>"
SCHEMA = "track string, seq long, smooth double, lasting boolean, emits boolean"


@dataclass(frozen=True)
class Gate:
    """Parameters of a gate: sigma of the causal smoothing, threshold, n of the last m, cooldown in seconds.

    A gate's state outlives gaps of its track; what gaps empty is the buffer of samples (Tubelets).
    """

    threshold: float
    sigma: float = 2.0
    n: int = 3
    m: int = 5
    cooldown: float = 5.0

    def fresh(self) -> dict:
        return {"scores": [], "hits": [], "active": False, "emitted": None}

    def step(self, state: dict, at: float, score: float | None) -> tuple[dict, tuple[float, bool, bool]]:
        """The next state and (smoothed score, persistent, emits).  The edge counts even while the cooldown holds it back; a score that is no number counts as 0."""
        score = float(score) if score is not None and math.isfinite(score) else 0.0
        radius = math.ceil(3 * self.sigma)
        scores = [*state["scores"], score][-(radius + 1) :]
        weights = [math.exp(-(k * k) / (2 * self.sigma**2)) if self.sigma > 0 else float(k == 0) for k in range(len(scores) - 1, -1, -1)]
        smooth = sum(w * s for w, s in zip(weights, scores, strict=True)) / sum(weights)
        hits = [*state["hits"], smooth > self.threshold][-self.m :]
        lasting = sum(hits) >= self.n
        ready = state["emitted"] is None or at - state["emitted"] >= self.cooldown
        emits = lasting and not state["active"] and ready
        return {"scores": scores, "hits": hits, "active": lasting, "emitted": at if emits else state["emitted"]}, (smooth, lasting, emits)


@dataclass(frozen=True)
class Tubelets:
    """A track's buffer of samples: once `length` are there, one window is emitted for each `stride` of the sample index.

    The camera looks for tracks to drop at each of its samples, after the sample's own tracks: one is dropped when its last
    sample is more than `stale` samples old, so a track that comes back after more than stale + 1 begins anew.
    """

    length: int
    stride: int
    stale: int = 75

    def fresh(self) -> dict:
        return {"rows": [], "seq": None, "emitted": None}

    def step(self, state: dict, seq: int, value: float) -> tuple[dict, list | None]:
        """The next state, and the values of the window that the sample completes."""
        if state["seq"] is not None and seq - state["seq"] > self.stale + 1:
            state = self.fresh()
        rows = [*state["rows"], value][-self.length :]
        due = len(rows) == self.length and (state["emitted"] is None or seq - state["emitted"] >= self.stride)
        return {"rows": rows, "seq": seq, "emitted": seq if due else state["emitted"]}, rows if due else None


def batch(samples: DataFrame, gate: Gate) -> DataFrame:
    """samples (track, seq, at, score) through the gate, in order of seq."""
    from watchplan.operators.windows import fold

    def step(state, row):
        track, seq, at, score = row
        state, out = gate.step(state, at, score)
        return state, [track, seq, *out]

    return fold(samples, ["track"], ["seq"], SCHEMA, gate.fresh, step, ["seq", "at", "score"])


GUARDED = "track string, seq long, smooth double, lasting boolean, emits boolean, reason string"


def guarded_step(gate: Gate, state: dict, at: float, score: float | None, reason: str | None) -> tuple[dict, tuple[float, bool, bool, str | None]]:
    """A sample with a reason against it goes by: its own score, nothing else, and the state stays as it is."""
    if reason is not None and not pd.isna(reason):
        return state, (float(score) if score is not None and math.isfinite(score) else 0.0, False, False, reason)
    state, out = gate.step(state, at, score)
    return state, (*out, None)


def guarded(samples: DataFrame, gate: Gate) -> DataFrame:
    """batch() of samples with `reason`: where it isn't null, the sample takes no part in smoothing, persistence or cooldown."""
    from watchplan.operators.windows import fold

    def step(state, row):
        track, seq, at, score, reason = row
        state, out = guarded_step(gate, state, at, score, reason)
        return state, [track, seq, *out]

    return fold(samples, ["track"], ["seq"], GUARDED, gate.fresh, step, ["seq", "at", "score", "reason"])


def live_guarded(samples: DataFrame, gate: Gate, late: str = "10 minutes") -> DataFrame:
    """guarded() over a stream."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        track, seq, at, score, reason = row
        state, made = guarded_step(gate, state, float(at), float(score), reason)
        return state, [(track, int(seq), *made)]

    return _stateful(samples, GUARDED, gate.fresh, step, ["seq", "at", "score", "reason"], late)


def _stateful(samples: DataFrame, schema: str, fresh: Callable[[], dict], step: Callable[[dict, tuple], tuple[dict, list[tuple]]], columns: list[str], late: str) -> DataFrame:
    """A fold by track over a stream: step(state, row) gives the next state and rows to emit.

    State is JSON kept by the engine.  Samples that come later than `late` behind the newest are dropped.  State is dropped when the watermark of event time (column ts) has passed a track's last sample
    by `late` twice: a timeout that a stream which ends (availableNow) comes to an end with, as one of processing time does not.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in schema.split(", ")]
    seconds = pd.Timedelta(late).total_seconds()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else fresh()
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for row in rows[columns].itertuples(index=False, name=None):
            now, made = step(now, (key[0], *row))
            out += made
        state.update((json.dumps(now),))
        last = int(rows["at"].max() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(2000 * seconds))
        yield pd.DataFrame(out, columns=names)

    timed = samples.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("ts", late)
    return timed.select("track", "ts", "at", *(c for c in columns if c != "at")).groupBy("track").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def live(samples: DataFrame, gate: Gate, late: str = "10 minutes") -> DataFrame:
    """batch() over a stream: the state (a bounded list) is kept by track and dropped when a track is idle."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        track, seq, at, score = row
        state, made = gate.step(state, float(at), float(score))
        return state, [(track, int(seq), *made)]

    return _stateful(samples, SCHEMA, gate.fresh, step, ["seq", "at", "score"], late)


def tubelets(samples: DataFrame, windows: Tubelets) -> DataFrame:
    """(track, seq, scores) of the windows of each track of samples (track, seq, at, score), in order of seq."""
    from watchplan.operators.windows import fold

    def step(state, row):
        state, made = windows.step(state, int(row[1]), float(row[3]))
        return state, None if made is None else [row[0], row[1], made]

    return fold(samples, ["track"], ["seq"], TUBELETS, windows.fresh, step, ["seq", "at", "score"])


def live_tubelets(samples: DataFrame, windows: Tubelets, late: str = "10 minutes") -> DataFrame:
    """tubelets() over a stream."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        state, made = windows.step(state, int(row[1]), float(row[3]))
        return state, [] if made is None else [(row[0], int(row[1]), made)]

    return _stateful(samples, TUBELETS, windows.fresh, step, ["seq", "at", "score"], late)


def frame_buffers(samples: DataFrame, frames: int, hit: str) -> DataFrame:
    """(track, seq, frames): the last `frames` samples, the hit's own among them, at each sample for which the condition `hit` holds."""
    w = Window.partitionBy("track").orderBy("seq").rowsBetween(-(frames - 1), 0)
    return samples.withColumn("frames", F.collect_list("seq").over(w)).where(hit).select("track", "seq", "frames")


def live_frame_buffers(samples: DataFrame, frames: int, least: float, late: str = "10 minutes") -> DataFrame:
    """frame_buffers() over a stream, for scores of at least `least`; the state is a bounded list."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        held = [*state["frames"], int(row[1])][-frames:]
        return {"frames": held}, [(row[0], int(row[1]), held)] if float(row[3]) >= least else []

    return _stateful(samples, "track string, seq long, frames array<long>", lambda: {"frames": []}, step, ["seq", "at", "score"], late)


def scheduled(frame: Column, motion: Column, tracks: Column, quiet_every: int) -> Column:
    """Whether a frame is searched: there is motion or a live track, or it is one of every quiet_every-th (0: none)."""
    every = F.lit(False) if quiet_every <= 0 else F.pmod(frame, F.lit(quiet_every)) == 0
    return F.coalesce(motion, F.lit(False)) | F.coalesce(tracks, F.lit(False)) | every


@dataclass(frozen=True)
class Recent:
    """Similarity dedup: a vector like one of the last `most`, at most ttl seconds old, is dropped, and a hit doesn't renew the time."""

    ttl: float = 3.0
    least: float = 0.72
    most: int = 50

    def step(self, held: list, at: float, v: list[float]) -> tuple[list, bool]:
        held = [(t, u) for t, u in held if at - t <= self.ttl]
        size = lambda x: math.sqrt(sum(i * i for i in x))
        like = lambda u: sum(a * b for a, b in zip(u, v, strict=True)) / (size(u) * size(v)) if size(u) and size(v) else 0.0
        if any(like(u) >= self.least for _, u in held):
            return held, False
        return [*held, (at, list(v))][-self.most :], True


def deduplicated(vectors: DataFrame, recent: Recent, by: str, at: str, vector: str, id_column: str) -> DataFrame:
    """(by, id) of vectors that are new within their camera, in order of time."""
    from watchplan.operators.windows import fold

    def step(held, row):
        held, new = recent.step(held, float(row[-3]), list(row[-2]))
        return held, ([row[0], row[-1]] if new else None)

    return fold(vectors, [by], [at, id_column], f"{by} long, {id_column} long", list, step, [at, vector, id_column])


def route(samples: DataFrame, step: int) -> DataFrame:
    """Every step-th sample."""
    return samples.where(F.col("seq") % step == 0)


def heartbeat(samples: DataFrame, by: str) -> DataFrame:
    """Per session: samples, first and last time, samples a second."""
    n = samples.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.min("at").alias("first"), F.max("at").alias("last"))
    return n.withColumn("fps", F.try_divide(F.col("samples") - 1, F.col("last") - F.col("first")))
