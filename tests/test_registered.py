"""Every registered query against its check text in DuckDB, on the smallest given tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as registered

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are absent")

# Spark and DuckDB names of the same types.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def comparable(rows):
    def text(value):
        return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)

    return sorted(tuple(text(v) for v in row) for row in rows)


OWN = [name for name in registered.queries() if name.startswith("q_")]


def test_every_query_has_a_check_text():
    assert set(OWN) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = registered.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    checked = duck.execute(registered.oracle_sql()[name])
    described = {c[0]: str(c[1]) for c in checked.description}
    assert sorted(described) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    places = [list(described).index(c) for c in columns]
    expected = comparable(tuple(row[i] for i in places) for row in checked.fetchall())
    assert comparable(df.select(*columns).collect()) == expected
    # These ask for one station or the newest hours, which the smallest tables may not have.
    assert expected or name in ("q_timeslice", "q_series_irregular", "q_timeslices_bulk")


def test_entry(spark):
    assert registered.entry(spark).columns[0] == "timeseries"
