"""Pairs of rules that may contradict, against plain code."""

import random

from watchplan.operators import joins as J


def _rules(spark, n=400, seed=3):
    rnd = random.Random(seed)
    pick = lambda values: rnd.choice(values)
    rows = [(k, pick(["trigger", "suppress", "other", None]), pick(["running", "other", "theft", None]), pick(["All", " Lobby", "lobby", "Gate", None])) for k in rnd.sample(range(10 * n), n)]
    return rows, spark.createDataFrame(rows, "id long, rule_type string, event string, place string")


def _conflicts(rows):
    out = []
    for i, t, e, p in rows:
        for j, u, f, q in rows:
            p_, q_ = (x and x.strip().lower() for x in (p, q))
            types = "other" in (t, u) or None not in (t, u) and t != u
            if i < j and types and ("other" in (e, f) or e is not None and e == f) and ("all" in (p_, q_) or p_ is not None and p_ == q_):
                out.append((i, j))
    return sorted(out)


def test_conflicts_are_made_once_without_a_shuffle_of_pairs(spark):
    rows, df = _rules(spark)
    found = J.conflicting_rules(df)
    assert sorted(map(tuple, found.collect())) == _conflicts(rows)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs were made distinct before
