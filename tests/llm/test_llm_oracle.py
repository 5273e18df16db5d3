import os
import sys

import pytest

from quern.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.compare(queries.queries()[name](spark, sf), oracle.connect(sf), queries.oracle_sql()[name])
