import pytest
from helpers import SF, agree

from ledgerloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_has_the_same_rows_again(spark, name):
    """The operators behind these are held against plain Python in test_operators and test_functions."""
    one, two = (sorted(map(str, catalog.queries()[name](spark, SF).collect())) for _ in range(2))
    assert one == two and one


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
