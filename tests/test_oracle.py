"""Every registered query next to its oracle statement."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# At this size a date slice of one contest hour may be empty; the queries still run.


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 7
    assert entry.queries().keys() >= QUERIES.keys()
