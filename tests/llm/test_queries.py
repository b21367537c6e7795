"""Every query of the subpackage on the small tables, against SQL where there is one."""

import pytest
from compare import assert_same

from cohortlab.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert_same(df, duck, ORACLES[name])
    else:
        assert df.count() > 0
