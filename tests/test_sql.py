"""Every registered query against its SQL."""

import pytest

from checks.compare import database, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, con, name):
    assert differences(spark, con, name, SF) == []
