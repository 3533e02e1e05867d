"""Short texts keep a likeness to their edits."""

import random

from watchplan.llm import winnow


def test_shared_half_is_found():
    r = random.Random(5)
    points = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz жизнь", k=n))
    for n in range(1, 260):
        text, half = points(n), (n + 1) // 2
        for following in (points(300), points(n // 4), points(1), ""):
            a, b = winnow.fingerprint(text), winnow.fingerprint(winnow.edited(text, following))
            assert winnow.likeness(a[0], b[0]) > 0, (n, following)
        if n >= 157:
            assert [x.tolist() for x in winnow.fingerprint(text)] == [x.tolist() for x in winnow.fingerprint(text, winnow.GRAM, winnow.WINDOW)]
