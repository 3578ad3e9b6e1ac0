"""Every catalogued query against its SQL; those without SQL run and are held against fixtures in test_operators."""

import oracle
import pytest

from tilecohort.plans import catalogue, cohort, indexed, logs, pixels  # noqa: F401  (the last ones add their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
