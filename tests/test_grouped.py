"""Work over groups of documents against the joins of queries with postings."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.operators import search
from textloom.operators.index import build, kept
from textloom.plans import ranking

TEXTS = ["common", "rare tie", "common alpha beta gamma", "alpha beta gamma delta common rare", "word17 common", "word3 word4 word5", "nothing", "", None, "common alpha beta gamma tie"]


@pytest.fixture(scope="module")
def many(spark):
    """Documents of several groups; lists that end within and with blocks, and begin in every place of one."""
    rng = random.Random(7)
    words = ["common", "rare", "tie", "alpha", "beta", "gamma", "delta"] + [f"word{i}" for i in range(60)]
    weights = [40, 0.3, 2, 9, 9, 9, 5] + [0.4] * 60
    rows = [(3 * i + rng.randrange(3), f"e{i}", " ".join(rng.choices(words, weights, k=rng.randrange(0, 12))) + " common" * (150 if i % 500 == 0 else 0)) for i in range(2500)]
    return kept(build(spark.createDataFrame(rows, "doc_id long, external_id string, text string")))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "common")], "query_id long, text string")


def refuse(*_):
    raise AssertionError("every query meets every posting in a shuffle")


def both(monkeypatch, run):
    """Rows from the groups, where no join of queries with postings is allowed, and from the joins."""
    monkeypatch.setattr(search, "contributions", refuse)
    groups = sorted(map(tuple, run().collect()))
    monkeypatch.undo()
    monkeypatch.setattr(search, "MOST_PLAN", 0)
    return groups, sorted(map(tuple, run().collect()))


@pytest.mark.parametrize("codec", ["vbyte", "raw"])
def test_exhaustive_work(monkeypatch, many, asked, codec):
    groups, joins = both(monkeypatch, lambda: search.exhaustive_work(many, asked, codec))
    assert groups == joins and len(groups) == 8


def test_candidate_union(monkeypatch, many, asked):
    groups, joins = both(monkeypatch, lambda: search.union_work(many, asked))
    assert groups == joins and len(groups) == 8


def test_observed_work_sums_the_groups(monkeypatch, spark, many, asked):
    """The observations are made of the groups; their sums are those of the work."""
    monkeypatch.setattr(search, "contributions", refuse)
    monkeypatch.setattr(ranking, "indexed", lambda *_: many)
    monkeypatch.setattr(ranking, "record_queries", lambda *_: asked)
    r = entry.queries()["observed_work"](spark, "").first()
    want = search.exhaustive_work(many, asked).agg(*[F.sum(c) for c in ("query_terms", "matched_terms", "postings_decoded", "blocks_decoded", "bytes", "candidates")]).first()
    assert tuple(r)[5:] == tuple(want) and r.queries == 8


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_search_gives_the_bits_of_the_joins(monkeypatch, many, asked, k):
    """Thresholds drop nothing: dense and sparse terms, ties, queries with fewer results than k."""
    groups, joins = both(monkeypatch, lambda: search.search(many, asked, k))
    assert groups == joins and len(groups) > k


def test_pruning_work(monkeypatch, many, asked):
    groups, joins = both(monkeypatch, lambda: search.pruning_work(many, asked, 5))
    assert groups == joins and len(groups) == 8 - 1 and any(p < e for _, e, p in groups)


def test_results_written_in_parts(monkeypatch, many, asked):
    """Batches of many results are answered queries by queries; nothing is lost between the parts."""
    whole = sorted(map(tuple, search.search(many, asked, 1000, digits=9).collect()))
    monkeypatch.setattr(search, "dense_best", refuse)
    monkeypatch.setattr(search, "MOST_ROWS", 3000)
    parts = sorted(map(tuple, search.search(many, asked, 1000, digits=9).collect()))
    assert parts == whole and len({r[0] for r in parts}) == 7


@pytest.mark.parametrize("name", ["mrr_at_10", "recall_at_k"])
def test_quality_of_known_items(monkeypatch, spark, many, name):
    """No task gives k rows for each query and group of documents, and the figures are those of the joins."""
    own = many.postings.filter("doc_id % 50 = 0").groupBy(F.col("doc_id").alias("query_id")).agg(F.concat_ws(" ", F.collect_list("term")).alias("text"))
    monkeypatch.setattr(ranking, "indexed", lambda *_: many)
    monkeypatch.setattr(ranking, "record_queries", lambda *_: own)
    monkeypatch.setattr(search, "dense_best", refuse)
    groups = sorted(map(tuple, entry.queries()[name](spark, "").collect()))
    monkeypatch.setattr(search, "MOST_PLAN", 0)
    assert groups == sorted(map(tuple, entry.queries()[name](spark, "").collect())) and 0 < groups[-1][-1] <= 1
