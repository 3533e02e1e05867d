"""Block pairs are compared a part at a time, with the same result."""

import tracemalloc

import numpy as np
import pandas as pd

from watchplan.operators import matching as O


def test_parts_of_a_block_pair_give_the_same_rows(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, (300, 4)).astype(float), rng.integers(0, 3, (500, 4)).astype(float)  # many ties
    qi, gi = np.arange(300), rng.permutation(500)
    pair = (qi, a.tobytes(), gi, b.tobytes())
    for metric in ("cosine", "euclidean"):
        value, cost = O.costs(a, b, metric)
        cost = np.where(qi[:, None] == gi[None, :], np.inf, np.round(cost, 12))
        want = [(q, gi[c], value[q, c]) for q in qi for c in np.lexsort((gi, cost[q]))[:10]]
        for cells in (1, 5000, 1 << 22):
            monkeypatch.setattr(O, "CELLS", cells)
            got = pd.concat(O.best_in_blocks([pair], metric, 10))
            assert [(q, g) for q, g, _ in want] == list(zip(got["query_id"], got["other_id"], strict=True)) and np.allclose(got["value"], [v for *_, v in want])


def test_a_pair_of_whole_blocks_is_not_held_at_once():
    rng = np.random.default_rng(7)
    v, ids = rng.normal(size=(O.BLOCK, 16)), np.arange(O.BLOCK)
    tracemalloc.start()
    for _ in O.best_in_blocks([(ids, v.tobytes(), ids, v.tobytes())], "euclidean", 10):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 << 20  # all costs are 32 MB, and were held several times
