"""Every query that has SQL gives the rows that DuckDB gives."""

import pytest

from tests import parity
from tidemark.plans.queries import oracle_sql, queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, parity.SF)
    if name in SQL:
        parity.same(df, SQL[name])
    else:
        assert df.count() > 0
