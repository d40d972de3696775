"""Every registered time-series query against its SQL."""

import pytest
from oracle import assert_same, run_sql

from tidewatt.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert_same(got, run_sql(ORACLE_SQL[name], SF))
    else:
        assert len(got)
