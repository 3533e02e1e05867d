"""Heartbeats of live queries: what a session has read so far and how fast, from the progress of its batches.

A session is a streaming query by name.  Its samples are observed in passing (counted in the tasks that read them, no
further job); a listener adds up what each finished batch reports.  A batch that is run again after a failure reports once: its number tells.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The name of the observation.
OBSERVED = "heartbeat"


def observed(samples: DataFrame) -> DataFrame:
    """samples (with `at`, seconds), whose count, first and last time every batch reports."""
    return samples.observe(OBSERVED, F.count(F.lit(1)).alias("samples"), F.min("at").alias("first"), F.max("at").alias("last"))


@dataclass(frozen=True)
class Beat:
    """A session's figures: batches, samples, first and last time of a sample, newest batch, and whether it has ended, and how."""

    batches: int = 0
    samples: int = 0
    first: float | None = None
    last: float | None = None
    newest: int = -1
    ended: bool = False
    error: str | None = None

    @property
    def fps(self) -> float | None:
        """Samples a second of event time; None below two moments."""
        return (self.samples - 1) / (self.last - self.first) if self.samples > 1 and self.last > self.first else None

    def after(self, batch: int, samples: int, first: float | None, last: float | None) -> Beat:
        if batch <= self.newest:
            return self
        least = [x for x in (self.first, first) if x is not None]
        most = [x for x in (self.last, last) if x is not None]
        return replace(self, batches=self.batches + 1, samples=self.samples + samples, first=min(least, default=None), last=max(most, default=None), newest=batch)


class Heartbeats(StreamingQueryListener):
    """Beats by session, of every query of the session that this listener is added to (spark.streams.addListener)."""

    def __init__(self) -> None:
        self._beats: dict[str, Beat] = {}
        self._names: dict[str, str] = {}
        self._lock = Lock()

    def beats(self) -> dict[str, Beat]:
        with self._lock:
            return dict(self._beats)

    def stale(self, now: float, seconds: float) -> list[str]:
        """Sessions that haven't ended and whose last sample is older than that."""
        return sorted(name for name, b in self.beats().items() if not b.ended and (b.last is None or now - b.last > seconds))

    def onQueryStarted(self, event) -> None:
        name = event.name or str(event.id)
        with self._lock:
            self._names[str(event.runId)] = name
            self._beats[name] = replace(self._beats.get(name, Beat()), ended=False, error=None)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(OBSERVED)
        if row is None:
            return
        name = progress.name or str(progress.id)
        with self._lock:
            self._beats[name] = self._beats.get(name, Beat()).after(progress.batchId, row["samples"], row["first"], row["last"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            name = self._names.pop(str(event.runId), str(event.id))
            self._beats[name] = replace(self._beats.get(name, Beat()), ended=True, error=event.exception)
