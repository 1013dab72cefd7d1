"""Every query of the catalogue against its SQL."""

import pytest

from lamella.plans import catalogue, catalogue_files  # noqa: F401


def same(got, want):
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a = got[cols].astype(str).sort_values(cols).reset_index(drop=True)
    b = want[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert len(a) == len(b)
    assert a.equals(b)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, data, name):
    same(catalogue.QUERIES[name](spark, data).toPandas(), duck.sql(catalogue.ORACLES[name]).df())


def test_entry_points(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_point_filters_reach_the_scan(spark, data):
    plan = catalogue.QUERIES["bw_threshold"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "label" not in plan.split("ReadSchema")[1]
