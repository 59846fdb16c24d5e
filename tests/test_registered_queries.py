"""Every registered query against DuckDB on the given tables."""

import datetime
import decimal
import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return repr(str(value))


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


# the training-data operators: those that SQL cannot express are tested beside them
OPTIONAL = re.compile(r"op\d+_|pipeline$")


def test_every_query_has_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert {n for n in QUERIES if not OPTIONAL.match(n)} == {n for n in ORACLES if not OPTIONAL.match(n)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.collect(), df.columns) == normal(expected.fetchall(), columns)


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns == ["type", "table", "column", "index", "message", "severity", "n_rows"]
