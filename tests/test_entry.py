"""Every query with SQL gives what the SQL gives, on the smallest tables; all others run."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


def plain(x):
    if isinstance(x, decimal.Decimal):
        return plain(float(x)) if x % 1 else int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return bytes(x) if isinstance(x, bytearray) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("p") or not n[1].isdigit() or n.startswith(("p4_", "p6_"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(columns, found.fetchall())
