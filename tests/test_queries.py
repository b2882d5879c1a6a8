"""Every query with an SQL twin gives the same rows; the others run."""

import pytest
from conftest import plain

from pulsegrid.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, data, name):
    ours = QUERIES[name](spark, data).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", ["b1_anchor_peaks", "t13_recut"])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_imports_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
