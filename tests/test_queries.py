"""Every query against its SQL, and those without SQL for their rows."""

import pytest

from skyloom import catalog

from .oracle import connect, differences

# run in test_all_objects.py
ELSEWHERE = {"M9_mixture_membership", "M10_density_membership", "M10_hierarchical_membership", "M11_hybrid_membership", "M12_stream_membership", "M14_bayesian_membership", "M17_quality_flags"}
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    found = differences(QUERIES[name](spark, sf), ORACLES[name], duck)
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - ELSEWHERE))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
