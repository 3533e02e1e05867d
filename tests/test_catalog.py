"""Every catalogue query against its SQL, or that it runs where it has none."""

import oracle
import pytest

from watchplan import catalog


#: Iterative or array work that SQL can't say; each has a test of its own against plain code.
WITHOUT_SQL = {
    "m04_mixture_scores": "test_operators.test_mixture", "m05_information_criteria": "test_operators.test_mixture",
    "m10_macro_features": "test_motion.test_macro_features", "m10b_all_macro_features": "test_motion.test_all_macro_features", "m11_pose_features": "test_motion.test_pose_features", "m20_pose_energy": "test_motion.test_pose_energy", "j20_iou_tracks": "test_processors.test_tracks_against_plain_code",
}


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connection(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, small, duck):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLES:
        assert oracle.difference(df, catalog.ORACLES[name], duck) == ""
    else:
        assert name in WITHOUT_SQL and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_plans_push_down_and_prune(spark, small):
    from watchplan.catalog.aggregates import people_seen_on_date

    plan = people_seen_on_date(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "BroadcastHashJoin" in plan
    assert "c_mktsegment" not in plan


def test_dashboard_and_parameters(spark, small):
    from watchplan.catalog.investigation import dashboard
    from watchplan.plans import investigation as I

    assert {len(dashboard(spark, small)[k]) for k in ("gates",)} == {3}
    assert len(I.CATALOGUE) >= 34
    with pytest.raises(ValueError):
        I.run("person_last_seen", spark, small)
    assert I.run("vad_cases", spark, small, limit=3, unknown_parameter=1).count() == 3
