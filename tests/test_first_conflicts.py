"""The first pairs of rules that may contradict."""

from test_rule_conflicts import _conflicts, _rules

from watchplan.operators import joins as J


def test_first_conflicts_meet_few_rules_alone(spark):
    rows, df = _rules(spark)
    want = _conflicts(rows)
    for most in (1, 7, 50):
        assert list(map(tuple, J.first_conflicts(df, most).collect())) == want[:most]
    assert J.first_conflicts(df.where("place = 'nowhere'"), 5).count() == 0
