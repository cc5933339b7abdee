"""Every registered core query against its SQL on DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from siltworks.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, data, con, name):
    df = catalogue.queries()[name](spark, data)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(cols)
        assert table(df.columns, rows) == table(cols, want.fetchall())
    else:
        assert rows
