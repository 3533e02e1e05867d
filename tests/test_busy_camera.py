"""Alerts of a camera with many events."""

import random

from watchplan.streaming.processors import Frequency


def test_alerts_of_a_busy_camera_are_counted_without_a_scan():
    class Counted(float):
        seen = 0

        def __rsub__(self, other):
            Counted.seen += 1
            return float(other) - float(self)

    f = Frequency(quiet=100.0, longest=5000.0)
    state, _ = f.step(f.fresh(), 1, 0.0, (1, 3, 700.3))
    rnd, times, sent = random.Random(2), [], None
    at = 0.0
    for _ in range(3000):
        at += rnd.choice([0.1, 0.3, 0.7, 400.0 if rnd.random() < 0.01 else 0.2])
        times = [t for t in times if at - t < 5000.0] + [at]
        n = sum(at - t < 700.3 for t in times)
        state, out = f.step(state, 1, Counted(at), None)
        want = n > 3 and (sent is None or at - sent >= 100.0)
        sent = at if want else sent
        assert [r[3] for r in out] == ([n] if want else [])
    assert Counted.seen < 3000 * 20  # each event against all of its past was a million and more
