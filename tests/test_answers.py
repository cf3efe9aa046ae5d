"""Every query against its SQL answer, on the smallest given tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, ANSWERS = entry.queries(), entry.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return repr(v)


def rows(names, records):
    order = sorted(names)
    return sorted(tuple(plain(r[c]) for c in order) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    got = [r.asDict(recursive=True) for r in df.collect()]
    if name not in ANSWERS:
        assert got
        return
    answer = duck.sql(ANSWERS[name])
    expected = [dict(zip(answer.columns, r)) for r in answer.fetchall()]
    assert sorted(df.columns) == sorted(answer.columns)
    duck_types = dict(zip(answer.columns, map(str, answer.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == duck_types
    assert rows(df.columns, got) == rows(df.columns, expected)


def test_every_answer_has_a_query():
    assert set(ANSWERS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
