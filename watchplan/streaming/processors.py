"""Live operators with typed state: trackers, dedup by similarity, debounce counters, frequency alerts.

Each is a plain step over a small state, which a fold runs over a table (the batch twin) and a stateful processor over a
stream.  The engine keeps the state by key: maps of open tracks and rules, lists of recent vectors and times, counters.  An event-time
timer drops a key's state once the watermark has passed its last row by `late`.  Within a micro-batch a key's rows
are taken in order; a row older than one of an earlier batch counts when it comes, one behind the watermark not at all.

Streams need the RocksDB state store: spark.sql.streaming.stateStore.providerClass (see ROCKSDB).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from watchplan.operators.windows import fold_many

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_TYPES = {"long": LongType(), "double": DoubleType(), "string": StringType(), "array<double>": ArrayType(DoubleType())}


def _schema(text: str) -> StructType:
    """Of "name type, name type"; tasks have no session that could parse it."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(", "))])


def _live(rows: DataFrame, by: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """rows (with `at`, seconds) by key through a processor, with a watermark `late` behind."""
    timed = rows.withColumn("_ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_ts", late)
    return timed.groupBy(by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=_schema(schema), outputMode="Append", timeMode="EventTime")


class _Processor(StatefulProcessor):
    """What the processors share: rows of a key in order, one timer a key that goes on with the key's last row."""

    order: list[str]
    names: list[str]

    def __init__(self, late: str):
        self.late_ms = int(pd.Timedelta(late).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def close(self) -> None:
        pass

    def open(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = max(int(frame["at"].max() * 1000), timerValues.getCurrentWatermarkInMs())
        for timer in list(self.handle.listTimers()):
            last = max(last, timer - self.late_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.late_ms)
        yield pd.DataFrame(self.taken(key[0], frame), columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self.ended(key[0]), columns=self.names)

    def taken(self, key, frame: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def ended(self, key) -> list[tuple]:
        raise NotImplementedError


# --- tracks by overlap ---


@dataclass(frozen=True)
class Tracker:
    """Tracks of boxes: each open track, in order of its number, takes the free detection that overlaps it most, from `least` on.

    A track that was missed in more than most_missed frames in a row ends; a detection that no track takes begins one.  A frame number
    that is left out is a frame without detections.
    """

    least: float = 0.3
    most_missed: int = 8

    def fresh(self) -> dict:
        return {"frame": None, "following": 1, "tracks": {}}

    def step(self, state: dict, frame: int, detections: list[tuple[int, tuple]]) -> tuple[dict, list[tuple[int, int]]]:
        """The next state and (detection, track) of a frame's detections (number, box)."""
        skipped = 0 if state["frame"] is None else max(0, frame - state["frame"] - 1)
        tracks = {k: (box, missed + skipped) for k, (box, missed) in state["tracks"].items() if missed + skipped <= self.most_missed}
        boxes = np.array([box for _, box in detections], float).reshape(-1, 4)
        free = np.ones(len(boxes), bool)
        took, still = [], {}
        for k in sorted(tracks):
            box, missed = tracks[k]
            score = np.where(free, overlap(np.array(box), boxes), -1.0)
            d = int(score.argmax()) if len(score) else -1
            if d >= 0 and score[d] > 0 and score[d] >= self.least:
                free[d] = False
                still[k] = (detections[d][1], 0)
                took.append((detections[d][0], k))
            elif missed + 1 <= self.most_missed:
                still[k] = (box, missed + 1)
        following = state["following"]
        for d in np.flatnonzero(free).tolist():
            still[following] = (detections[d][1], 0)
            took.append((detections[d][0], following))
            following += 1
        return {"frame": frame, "following": following, "tracks": still}, took


def overlap(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Intersection over union of a box with each of boxes; 0 where both are empty."""
    w = np.minimum(box[2], boxes[:, 2]) - np.maximum(box[0], boxes[:, 0])
    h = np.minimum(box[3], boxes[:, 3]) - np.maximum(box[1], boxes[:, 1])
    common = np.maximum(0, w) * np.maximum(0, h)
    area = lambda b: np.maximum(0, b[..., 2] - b[..., 0]) * np.maximum(0, b[..., 3] - b[..., 1])
    union = area(box) + area(boxes) - common
    return np.divide(common, union, out=np.zeros(len(boxes)), where=union > 0)


_BOX = ["x1", "y1", "x2", "y2"]


def tracks(detections: DataFrame, tracker: Tracker, by: str = "camera") -> DataFrame:
    """(by, frame, det, track) of detections (by, frame, det, x1, y1, x2, y2), camera by camera, frame by frame.

    The open tracks and one frame's detections are held.
    """

    def flush(held: tuple) -> tuple[tuple, list[tuple]]:
        key, state, frame, found = held
        if not found:
            return held, []
        state, took = tracker.step(state, frame, found)
        return (key, state, frame, []), [(key, frame, d, t) for d, t in took]

    def step(held: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        key, frame, det, *box = row
        out = []
        if held[2] != frame:
            held, out = flush(held)
        return (key, held[1], frame, [*held[3], (det, tuple(box))]), out

    return fold_many(detections, [by], ["frame", "det"], f"{by} long, frame long, det long, track long", lambda: (None, tracker.fresh(), None, []), step, lambda held: flush(held)[1], ["frame", "det", *_BOX])


class _Tracks(_Processor):
    order, names = ["frame", "det"], ["camera", "frame", "det", "track"]

    def __init__(self, tracker: Tracker, late: str):
        super().__init__(late)
        self.tracker = tracker

    def open(self) -> None:
        self.at = self.handle.getValueState("at", _schema("frame long, following long, newest long"))
        self.tracks = self.handle.getMapState("tracks", _schema("track long"), _schema("x1 double, y1 double, x2 double, y2 double, missed long"))
        # the newest frame's detections: it is complete when a later one begins
        self.newest = self.handle.getListState("newest", _schema("det long, x1 double, y1 double, x2 double, y2 double"))

    def _state(self) -> tuple[dict, int | None, list[tuple]]:
        frame, following, newest = self.at.get() if self.at.exists() else (None, 1, None)
        open_ = {k[0]: (tuple(v[:4]), v[4]) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        held = [(r[0], tuple(r[1:5])) for r in self.newest.get()] if self.newest.exists() else []
        return {"frame": frame, "following": following, "tracks": open_}, newest, held

    def taken(self, key, frame: pd.DataFrame) -> list[tuple]:
        state, newest, held = self._state()
        out = []
        for f, det, *box in frame[["frame", "det", *_BOX]].itertuples(index=False, name=None):
            if newest is not None and f != newest:
                state, took = self.tracker.step(state, newest, held)
                out += [(key, newest, d, t) for d, t in took]
                held = []
            newest = int(f)
            held.append((int(det), tuple(map(float, box))))
        self.at.update((state["frame"], state["following"], newest))
        self.tracks.clear()
        for k, (box, missed) in state["tracks"].items():
            self.tracks.updateValue((k,), (*box, missed))
        self.newest.put([(d, *box) for d, box in held])
        return out

    def ended(self, key) -> list[tuple]:
        state, newest, held = self._state()
        took = self.tracker.step(state, newest, held)[1] if held else []
        for s in (self.at, self.tracks, self.newest):
            s.clear()
        return [(key, newest, d, t) for d, t in took]


def live_tracks(detections: DataFrame, tracker: Tracker, late: str = "10 seconds") -> DataFrame:
    """tracks() over a stream of detections with `at`; a frame is tracked when a later one of its camera begins, or at the camera's end."""
    rows = detections.select("camera", "frame", "det", *_BOX, "at")
    return _live(rows, "camera", _Tracks(tracker, late), "camera long, frame long, det long, track long", late)


# --- dedup by similarity ---


class _Fresh(_Processor):
    names = ["camera", "id"]
    order = ["at", "id"]

    def __init__(self, recent, late: str):
        super().__init__(late)
        self.recent = recent

    def open(self) -> None:
        self.held = self.handle.getListState("held", _schema("at double, v array<double>"))

    def taken(self, key, frame: pd.DataFrame) -> list[tuple]:
        held = [(r[0], list(r[1])) for r in self.held.get()] if self.held.exists() else []
        out = []
        for at, i, v in frame[["at", "id", "v"]].itertuples(index=False, name=None):
            held, new = self.recent.step(held, float(at), [float(x) for x in v])
            out += [(key, int(i))] if new else []
        if held:
            self.held.put([(t, u) for t, u in held])
        else:
            self.held.clear()
        return out

    def ended(self, key) -> list[tuple]:
        self.held.clear()
        return []


def live_deduplicated(vectors: DataFrame, recent, late: str = "10 seconds") -> DataFrame:
    """gates.deduplicated() over a stream of (camera, at, id, v): (camera, id) of what is new; what is older than the time to live leaves the state."""
    return _live(vectors.select("camera", "at", "id", "v"), "camera", _Fresh(recent, late), "camera long, id long", late)


# --- debounce ---


class _Debounce(_Processor):
    names = ["track", "id"]
    order = ["at", "id"]

    def __init__(self, fire_at: int, late: str):
        super().__init__(late)
        self.fire_at = fire_at

    def open(self) -> None:
        self.count = self.handle.getValueState("count", _schema("n long"))

    def taken(self, key, frame: pd.DataFrame) -> list[tuple]:
        n, out = self.count.get()[0] if self.count.exists() else 0, []
        for i, hit in frame[["id", "hit"]].itertuples(index=False, name=None):
            n = n + 1 if hit else max(0, n - 1)
            if n >= self.fire_at:
                n = 0
                out.append((key, int(i)))
        self.count.update((n,))
        return out

    def ended(self, key) -> list[tuple]:
        self.count.clear()
        return []


def live_debounced(samples: DataFrame, fire_at: int, late: str = "10 seconds") -> DataFrame:
    """windows.debounced() over a stream of (track, at, id, hit): (track, id) of each firing."""
    return _live(samples.select("track", "at", "id", "hit"), "track", _Debounce(fire_at, late), "track string, id long", late)


# --- frequency alerts that remember ---

ALERTS = "camera_id long, rule_id long, at double, n long, threshold long, text string"


def _since(times: list[float], at: float, seconds: float) -> int:
    """The place of the first of the ascending times that is less than `seconds` before at."""
    k = bisect_left(times, at - seconds)
    while k < len(times) and at - times[k] >= seconds:
        k += 1
    while k and at - times[k - 1] < seconds:  # at - seconds was rounded
        k -= 1
    return k


@dataclass(frozen=True)
class Frequency:
    """More than `threshold` events of a camera within `seconds`, by rules that change; a rule stays silent for `quiet` seconds after an alert.

    A rule counts from the time of its change on, until the next change of it; a null threshold ends it.  Events are kept
    for `longest` seconds; a rule over more than that is an error.
    """

    quiet: float = 30.0
    longest: float = 3600.0

    def fresh(self) -> dict:
        return {"rules": {}, "times": [], "sent": {}}

    def step(self, state: dict, camera: int, at: float, rule: tuple | None) -> tuple[dict, list[tuple]]:
        """rule: (rule_id, threshold, seconds) of a change, or None for an event."""
        rules, times, sent = state["rules"], state["times"], state["sent"]
        if rule is not None:
            if rule[2] > self.longest:
                raise ValueError(f"rule {rule[0]} over {rule[2]} seconds, more than {self.longest}")
            rules = {k: v for k, v in rules.items() if k != rule[0]} | ({} if rule[1] is None else {rule[0]: rule[1:]})
            return {"rules": rules, "times": times, "sent": sent}, []
        # times are in order, so those within a span are all from a place on; the oldest are dropped when they are half of the list, not one by one
        gone = _since(times, at, self.longest)
        if 2 * gone >= len(times):
            del times[:gone]
        insort(times, at)
        out, sent = [], dict(sent)
        for k in sorted(rules):
            threshold, seconds = rules[k]
            n = len(times) - _since(times, at, seconds)
            if n > threshold and (k not in sent or at - sent[k] >= self.quiet):
                sent[k] = at
                out.append((camera, k, at, n, threshold, f"High frequency access: {n} attempts in {seconds:g}s (threshold: {threshold})"))
        return {"rules": rules, "times": times, "sent": sent}, out


def changes_and_events(events: DataFrame, rules: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera_id, at, kind, rule_id, threshold, seconds): rule changes (0) and events (1) by camera.

    A rule without a camera becomes one for each of cameras, a table of bounded size, so that no key has all events.
    """
    own = rules.where(F.col("camera_id").isNotNull()).select("camera_id", "at", F.lit(0).alias("kind"), "rule_id", "threshold", "seconds")
    every = rules.where(F.col("camera_id").isNull()).drop("camera_id").crossJoin(F.broadcast(cameras.select("camera_id")))  # rules are few, cameras a dimension
    all_rules = own.unionByName(every.select("camera_id", "at", F.lit(0).alias("kind"), "rule_id", "threshold", "seconds"))
    none = F.lit(None)
    return all_rules.unionByName(events.select("camera_id", "at", F.lit(1).alias("kind"), none.cast("long").alias("rule_id"), none.cast("long").alias("threshold"), none.cast("double").alias("seconds")))


def _rule(kind: int, rule_id, threshold, seconds) -> tuple | None:
    return None if kind == 1 else (int(rule_id), None if pd.isna(threshold) else int(threshold), 0.0 if pd.isna(seconds) else float(seconds))


def alerts(rows: DataFrame, frequency: Frequency) -> DataFrame:
    """Alerts of changes_and_events(), camera by camera in order of time; of one time, changes come first, by rule."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        camera, at, kind, *rule = row
        return frequency.step(state, camera, at, _rule(kind, *rule))

    return fold_many(rows, ["camera_id"], ["at", "kind", "rule_id"], ALERTS, frequency.fresh, step, lambda state: [], ["at", "kind", "rule_id", "threshold", "seconds"])


class _Alerts(_Processor):
    order, names = ["at", "kind", "rule_id"], [c.split()[0] for c in ALERTS.split(", ")]

    def __init__(self, frequency: Frequency, late: str):
        super().__init__(late)
        self.frequency = frequency

    def open(self) -> None:
        self.rules = self.handle.getMapState("rules", _schema("rule_id long"), _schema("threshold long, seconds double"))
        self.times = self.handle.getListState("times", _schema("at double"))
        self.sent = self.handle.getMapState("sent", _schema("rule_id long"), _schema("at double"))

    def taken(self, key, frame: pd.DataFrame) -> list[tuple]:
        read = lambda state: list(state.iterator()) if state.exists() else []
        state = {
            "rules": {k[0]: (v[0], v[1]) for k, v in read(self.rules)}, "sent": {k[0]: v[0] for k, v in read(self.sent)},
            "times": [r[0] for r in self.times.get()] if self.times.exists() else [],
        }
        before, out = state, []
        for at, *rule in frame[["at", "kind", "rule_id", "threshold", "seconds"]].itertuples(index=False, name=None):
            state, made = self.frequency.step(state, key, float(at), _rule(*rule))
            out += made
        for k in before["rules"].keys() - state["rules"].keys():
            self.rules.removeKey((k,))
        for k, v in state["rules"].items():
            self.rules.updateValue((k,), v)
        for k, at in state["sent"].items():
            self.sent.updateValue((k,), (at,))
        if state["times"]:
            self.times.put([(t,) for t in state["times"]])
        return out

    def ended(self, key) -> list[tuple]:
        self.times.clear()  # rules outlive a silent camera, and so does when they last spoke
        return []


def live_alerts(rows: DataFrame, frequency: Frequency, late: str = "2 minutes") -> DataFrame:
    """alerts() over a stream of changes_and_events() of two streams; rules and the times of their last alerts are kept across batches."""
    return _live(rows, "camera_id", _Alerts(frequency, late), ALERTS, late)


def latest_rules(rules: DataFrame) -> DataFrame:
    """Of changes (rule_id, camera_id, at, ...), each rule's last one, with its version (1, 2, ...)."""
    w = Window.partitionBy("rule_id", "camera_id").orderBy("at")
    return rules.withColumn("version", F.row_number().over(w)).withColumn("_last", F.lead("at").over(w).isNull()).where("_last").drop("_last")

