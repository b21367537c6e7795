"""Every core query on the small tables, against its SQL where there is one."""

import pytest
from compare import assert_same

from cohortlab.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, duck, name):
    assert_same(QUERIES[name](spark, small), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
