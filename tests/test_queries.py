"""Every query against its SQL at the smallest scale; the rest must give rows."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    same, n, detail = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert same is not False, detail
    assert n > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["p_partkey", "p_retailprice", "p_size", "p_brand", "p_type"]
    assert df.count() == 200


def test_impute_lineitem_against_all_pairs(spark, con):
    """The query whose SQL is too slow for larger tables."""
    from checks.neighbors import LINES_SQL, impute_lineitem

    same, n, detail = compare(spark, con, FOLDER, "impute_lineitem", impute_lineitem, LINES_SQL)
    assert same and n == 6000, detail
