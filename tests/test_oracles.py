"""Every registered query against its SQL counterpart at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES = dict(spark_entry._QUERIES)  # without those of the training-data subpackage, which has its own tests
ORACLES = {name: sql for name, sql in spark_entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.8f}" if isinstance(value, (int, float)) else str(value)


def _canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    ours = _canonical(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    theirs = _canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert ours[1], "an empty result checks nothing"


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


MINED = ["adverse_sequences", "frequent_sequences", "frequent_event_sequences", "frequent_itemset_sequences", "sequence_states", "sequence_flags", "sequence_study"]


@pytest.mark.parametrize("name", MINED)
def test_last_level_of_the_sql_is_empty(duck, name):
    """The SQL unrolls a fixed number of levels; mining ends by itself, so the last has to be empty."""
    head = ORACLES[name].split("mined AS MATERIALIZED")[0]
    found = duck.execute(f"{head.rstrip().rstrip(',')} SELECT count(*) FROM f6").fetchone()
    assert found == (0,)


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 20
