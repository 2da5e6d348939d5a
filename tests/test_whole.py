"""Queries that take all rows of their tables, against plain Python over the smallest tables."""

from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


def columns(name, *names):
    table = pq.read_table(f"{DATA}/{name}.parquet", columns=list(names))
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def test_catalog_of_every_result(spark):
    """All results of a query are looked up, whatever rank one worker saw."""
    results = {(q, str(d)) for q, d in columns("search_result", "query_id", "doc_id")}
    lines = {str(o): " ".join((t or "").split()) for o, t in columns("corpus_record", "ordinal", "text")}
    joined = [(r.query_id, r.external_id, r.preview) for r in entry.queries()["catalog_join"](spark, DATA).collect()]
    assert len(joined) == len(results) and {x[:2] for x in joined} == results
    assert all(preview == (lines.get(d) or None) for _, d, preview in joined)
    orphans = [tuple(r) for r in entry.queries()["catalog_orphans"](spark, DATA).select("query_id", "external_id").collect()]
    assert sorted(orphans) == sorted((q, d) for q, d in results if not lines.get(d))


def test_cursors_of_every_term(spark):
    """Also lists of one or two postings are advanced; a linear scan gives the same."""
    lists = defaultdict(list)
    for r in entry.queries()["postings"](spark, DATA).collect():
        lists[r.term].append((r.doc_id, r.tf))
    most = max(d for (d,) in columns("documents", "doc_id"))
    want = set()
    for term, found in lists.items():
        found.sort()
        for target in {1, most // 2, most}:
            hit = next((x for x in found if x[0] >= target), (None, None))
            skipped = sum(found[min(at + 127, len(found) - 1)][0] < target for at in range(128, len(found), 128))
            want.add((term, target, *hit, skipped))
    assert any(len(found) < 3 for found in lists.values())
    got = [(r.term, r.target, r.doc_id, r.tf, r.blocks_skipped) for r in entry.queries()["cursor_advance"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want
