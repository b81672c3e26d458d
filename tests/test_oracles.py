import pytest

import __spark_entry__ as entry
from chronoframe.plans import ORACLES, QUERIES
from tests.oracle import assert_matches


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_matches(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
