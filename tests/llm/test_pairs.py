"""Pairs of groups where one group holds half of all rows, against plain Python."""

import itertools
from collections import defaultdict
from pathlib import Path

import pytest

from textloom.llm import pairs as P
from textloom.llm import queries as Q
from textloom.llm.lookalike import form_keys, learn_rules

DATA = "/root/testdata/sf0.001"


def grouped():
    rows = [("hot", i) for i in range(120)] + [(f"g{i % 40}", 1000 + i) for i in range(110)] + [("one", 5000)]
    by = defaultdict(list)
    for g, x in rows:
        by[g].append(x)
    return rows, by


@pytest.mark.parametrize("block", [P.BLOCK, 16])
def test_groups_and_links(spark, block):
    rows, by = grouped()
    members = spark.createDataFrame([*rows, (None, 7), ("g1", None)], "g string, x long")
    links = [("hot", "one"), ("g0", "g1"), ("g0", "hot"), ("gone", "g2")]
    got = [tuple(r) for r in P.linked_pairs(spark.createDataFrame(links, "a string, b string"), members, "g", "x", block).collect()]
    want = {tuple(sorted(p)) for xs in by.values() for p in itertools.combinations(xs, 2)}
    want |= {tuple(sorted((x, y))) for a, b in links for x in by.get(a, []) for y in by.get(b, [])}
    assert len(got) == len(set(got)) and set(got) == want
    within = [tuple(r) for r in P.group_pairs(members, "g", "x", block).collect()]
    assert sorted(within) == sorted((g, *sorted(p)) for g, xs in by.items() for p in itertools.combinations(xs, 2))


def test_blocks_of_a_hot_group_are_small(spark):
    rows, _ = grouped()
    cut = P.blocked(spark.createDataFrame(rows, "g string, x long"), "g", "x", 16, 2)
    sizes = {(r.g, r.i): r["count"] for r in cut.groupBy("g", "i").count().collect()}
    assert sum(sizes.values()) == 230 and max(n for (g, _), n in sizes.items() if g == "hot") <= 32
    assert all(r.k == 8 and r.more for r in cut.filter("g = 'hot'").collect())


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
def test_classes_of_look_alikes(spark):
    articles = spark.read.parquet(f"{DATA}/dump_article.parquet").select("page_id", "title", "text")
    strings, held = defaultdict(set), {}
    for r in form_keys(articles, "page_id", ["title", "text"], learn_rules(articles, ["title", "text"])).collect():
        strings[r.field, bytes(r.form_key)].add(bytes(r.string_key))
        held.setdefault((r.page_id, r.field), set()).add(bytes(r.form_key))
    got = {(r.page_id, r.field, bytes.fromhex(r["class"]), r.links) for r in Q.p1_groups(spark, DATA).collect()}
    assert got == {(k, f, form, len(strings[f, form]) - 1) for (k, f), forms in held.items() for form in forms}
    assert any(links for *_, links in got)
