import os

import pytest

from foliospark.plans import registry
from oracle import compare, connection

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert compare(spark, con, registry.queries()[name], SQL[name], FOLDER) is None
