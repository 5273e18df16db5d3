import pytest
import oracle

from quern.plans import composites, queries  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name]) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
