"""Every registered query against its DuckDB oracle on the smallest data set."""

import pytest

import __spark_entry__ as E
from graphbi.catalog import ORACLE_SQL, QUERIES
from oracle_util import canon, duck

SF = "/root/testdata/sf0.001"
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "isComment", "lengthCategory", "messageCount", "averageMessageLength",
                          "sumMessageLength", "percentageOfMessages"]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(ORACLE_SQL[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert canon(rows, cols) == canon(orows, ocols)
