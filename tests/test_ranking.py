"""The index and its rankings against a plain model, and the pinned small corpora."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from textloom.functions import bm25
from textloom.functions.analysis import analyze
from textloom.operators import evaluate, search
from textloom.operators.index import build, build_report, kept, merge
from textloom.operators.search import _List, pivot_evaluation

PINNED = [(0, "shared", "Fast search index"), (1, "shared", "Small search index"), (2, "repeat", "disk disk disk disk"), (3, "unicode", "Café Straße"), (4, "empty", "")]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, external_id string, text string").withColumn("rank", F.lit("clash"))


def model(rows, query, k):
    docs = {i: analyze(t) for i, _, t in rows if i is not None}
    some = [t for t in docs.values() if t]
    if not some or k <= 0:
        return []
    n, average = len(some), sum(map(len, some)) / len(some)
    scores = {}
    for term in sorted(set(analyze(query))):
        df = sum(term in t for t in docs.values())
        for i, t in docs.items():
            if term in t:
                scores[i] = scores.get(i, 0.0) + bm25.py_score(bm25.py_idf(n, df), t.count(term), len(t), average)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def bits(rows):
    return [(i, struct.pack("<d", s)) for i, s in rows]


def test_pinned_corpus(spark):
    index = kept(build(corpus(spark, PINNED)))
    stats = index.stats.first()
    assert tuple(stats) == (5, 4, 12, 3.0)
    assert tuple(build_report(index).first()) == (5, 4, 12, 9)
    expected = {
        "missing FAST fast": [(0, 1.203972804325936)],
        "search index": [(0, 1.386294361119891), (1, 1.386294361119891)],
        "---": [],
    }
    for query, want in expected.items():
        got = [(r.doc_id, r.score) for r in search.search_one(index, query, 10).orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(math.isclose(a, b, abs_tol=1e-12) for (_, a), (_, b) in zip(got, want, strict=True))
    got = search.search_one(index, "fast disk", 1).collect()
    assert [(r.doc_id, r.external_id) for r in got] == [(2, "repeat")] and math.isclose(got[0].score, 1.822747671887871, abs_tol=1e-12)
    assert search.search_one(index, "fast", 0).count() == 0


def random_corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["common", "rare", "tie", "alpha", "beta", "gamma", "delta", "strasse"]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = None if kind < 0.03 else "" if kind < 0.06 else " ".join(rng.choices(words, weights=[20, 1, 2, 5, 5, 5, 3, 2], k=rng.randrange(1, 33)))
        rows.append((i, rng.choice(["same", f"e{i}", None]), text))
    return rows + [(None, "nokey", "common")]


@pytest.mark.parametrize("seed", [13, 29])
def test_executors_equal_the_model_bit_for_bit(spark, seed):
    rows = random_corpus(seed)
    df = corpus(spark, rows)
    whole = kept(build(df))
    parts = kept(merge([build(df.filter(F.col("doc_id") % 3 == i)) for i in range(3)]))
    texts = ["common", "rare tie", "tie tie alpha beta", "nothing", "", "alpha beta gamma delta common rare", None]
    queries = spark.createDataFrame(list(enumerate(texts)) + [(None, "common")], "query_id long, text string")
    for k in (1, 7, 1000):
        want = {i: bits(model(rows, t or "", k)) for i, t in enumerate(texts)}
        for index in (whole, parts):
            for executor in search.EXECUTORS:
                got = {i: [] for i in want}
                for r in search.search(index, queries, k, executor).orderBy("query_id", "rank").collect():
                    got[r.query_id].append((r.doc_id, struct.pack("<d", r.score)))
                assert got == want, (k, executor)
    counters = {r.query_id: r for r in search.pivot_work(whole, queries, 1).collect()}
    work = {r.query_id: r for r in search.exhaustive_work(whole, queries).collect()}
    for i, r in counters.items():
        assert r.candidates_scored <= work[i].candidates and r.matched_terms == work[i].matched_terms and r.query_terms == work[i].query_terms
    with pytest.raises(ValueError):
        search.search(whole, queries, 1, "oracle")


def test_plans_beyond_the_bound_are_joined(spark, monkeypatch):
    rows = random_corpus(5)
    index = kept(build(corpus(spark, rows)))
    queries = spark.createDataFrame([(1, "alpha beta common"), (2, "rare tie")], "query_id long, text string")
    small = {e: sorted(map(tuple, search.search(index, queries, 5, e).collect())) for e in search.EXECUTORS}
    monkeypatch.setattr(search, "MOST_PLAN", 2)
    large = {e: sorted(map(tuple, search.search(index, queries, 5, e).collect())) for e in search.EXECUTORS}
    key = lambda found: [r[:3] + (struct.pack("<d", r[4]),) for r in found]
    assert key(small["exhaustive"]) == key(small["pruned"]) == key(large["exhaustive"]) == key(large["pruned"])


def test_empty_corpus(spark):
    index = build(corpus(spark, []))
    assert tuple(index.stats.first()) == (0, 0, 0, 0.0)
    assert search.search(index, spark.createDataFrame([(1, "x")], "query_id long, text string")).count() == 0


def lists(docs, terms):
    import numpy as np

    cut = [d.split() for d in docs]
    some = [d for d in cut if d]
    average = sum(map(len, some)) / len(some)
    out = []
    for t in sorted(set(terms.split())):
        ids = [i for i, d in enumerate(cut) if t in d]
        if ids:
            tf = [cut[i].count(t) for i in ids]
            idf = bm25.py_idf(len(some), len(ids))
            out.append(_List(np.array(ids), np.array(tf), np.array([len(cut[i]) for i in ids]), np.array([2 * min(128, len(ids) - b) for b in range(0, len(ids), 128)]), idf, bm25.py_score(idf, max(tf), max(tf), average)))
    return out, average


def test_pivot_counters_on_pinned_corpora():
    got, work = pivot_evaluation(*lists(["term"] * 3, "term")[:1], 1, 1.0)
    assert [i for i, _ in got] == [0] and work["candidates_scored"] == 1 and work["threshold_changes"] == 1 and work["bytes_requested"] == 14
    got, work = pivot_evaluation(*(lambda x: (x[0], 1, x[1]))(lists(["seed seed seed seed", "common", "common rare", "common pivot", "common"], "seed common rare pivot")))
    assert work["pivot_selections"] == 1 and work["candidates_scored"] == 1 and work["advance_calls"] == 1
    got, work = pivot_evaluation(*(lambda x: (x[0], 1, x[1]))(lists(["term filler", "term"], "term")))
    assert [i for i, _ in got] == [1] and work["candidates_scored"] == 2 and work["pivot_selections"] == 1 and work["threshold_changes"] == 2
    got, work = pivot_evaluation(*(lambda x: (x[0], 1, x[1]))(lists(["rare rare rare rare common", *["common"] * 5], "rare common")))
    assert work["candidates_scored"] == 1
    got, work = pivot_evaluation(*(lambda x: (x[0], 1, x[1]))(lists(["term filler"] * 3, "term")))
    assert work["candidates_scored"] == 3


def test_evaluation(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (2, 20, 1), (3, 30, 1), (1, 10, 0)], "query_id long, doc_id long, rel int")
    assert tuple(evaluate.reciprocal_rank(run, qrels).first()) == (3, pytest.approx((0.5 + 1 / 3) / 3))
    assert {r.k: r.recall for r in evaluate.recall(run, qrels, (1, 10)).collect()} == {1: 0.0, 10: pytest.approx(0.5)}
    lat = spark.createDataFrame([("a", v) for v in (40, 10, 30, 20, None)], "g string, v long")
    assert tuple(evaluate.nearest_rank(lat, ["g"], "v").first()) == ("a", 4, 20, 40, 40, 40)
    obs = spark.createDataFrame([(1, "raw", "x", 10, "ok", 3, 10**9), (1, "raw", "x", 10, "ok", 10, 10**9), (1, "raw", "x", 10, "error", 0, 10**9)], "repetition int, codec string, executor string, k int, status string, results int, nanoseconds long")
    r = evaluate.observation_summary(obs).first()
    assert (r.queries, r.failures, r.short_results, r.queries_per_second) == (3, 1, 1, 1.0)
    assert evaluate.merge_passes([1, 2, 3], 2) == [[[0, 1], [2]], [[0, 1]]]
    b = evaluate.build_rates(spark.createDataFrame([(10, 20, 30, 1048576, 60, 2.0)], "documents long, tokens long, postings long, input_bytes long, index_bytes long, seconds double")).first()
    assert (b.documents_per_second, b.input_mib_per_second, b.bytes_per_posting) == (5.0, 0.5, 2.0)


def test_run_bytes_of_the_pinned_build(spark):
    index = build(corpus(spark, [(0, "a", "go go"), (1, "b", "go search"), (2, "c", "")]))
    sizes = {r.segment: r.bytes for r in evaluate.run_bytes(index, 1).collect()}
    assert sizes == {0: 24 + 12 + 2 + 8, 1: 24 + 12 + 2 + 8 + 12 + 6 + 8, 2: 24}


def test_segment_report_of_the_pinned_build(spark):
    index = kept(build(corpus(spark, [(0, "a", "go go"), (1, "b", "go search"), (2, "c", "")])))
    r = evaluate.segment_report(index, 1, 2).first()
    assert tuple(r) == (3, 2, 4, 3, 3, 2, 222, 160)
    assert tuple(evaluate.segment_report(index, 10, 2).first())[4:] == (1, 0, 0, 0)
