"""Every query of the library against its SQL twin; optional subpackages test their own."""

import pytest

import __spark_entry__
from oracle import connect, differences
from pricemill.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert differences(df, con, __spark_entry__.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    # A fitted model is not the same in two engines; tests/test_catalog.py tests it.
    assert set(QUERIES) == set(ORACLE_SQL) | {"price_model"}
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_pairs == 200 and 0 < rows[0].smape < 200
