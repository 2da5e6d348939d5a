"""Every llm query on the smallest tables, against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
COLUMNS = {"p1_found": "page_id_a page_id_b field", "p2_found": "scope term", "p3_found": "page_id_a page_id_b", "p5_found": "query_id doc_id", "p7_found": "ordinal term", "p8_ids": "doc_id ids", "p10_found": "doc_id kind found"}


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
        assert len(rows) == len(set(map(repr, rows)))
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        order = lambda cs, rs: sorted(repr([plain(r[cs.index(c)]) for c in sorted(cs)]) for r in rs)
        assert order(df.columns, rows) == order(columns, found.fetchall())
