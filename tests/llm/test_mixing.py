import random
from collections import defaultdict

import pytest

from textloom.llm.mixing import mix


def made(seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "small", "none", None]), rng.choice([0, None, 5, rng.randrange(1, 400), rng.randrange(1, 4000)]) if rng.random() < 0.9 else 1) for i in range(n)]
    return [(i, s, t if s != "small" or i % 20 == 0 else 0) for i, s, t in rows]


TARGETS = [("hot", 0.3, 1), ("a", 0.35, 2), ("b", 0.25, 3), ("small", 0.08, 4), ("missing", 0.02, 3)]


def test_shares(spark):
    rows = made()
    sizes = spark.createDataFrame(rows + rows[:200], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame(TARGETS + [(None, 0.5, 1)], "source string, target_share double, max_repeats int")
    done = mix(sizes, targets)
    tokens = {i: (s, t or 0) for i, s, t in rows}
    listed = {s for s, *_ in TARGETS}
    whole = 0.5 * sum(t for s, t in tokens.values() if s in listed)
    got = defaultdict(int)
    copies = done.copies.collect()
    assert len(copies) == len({r.doc_id for r in copies})
    limit = {s: r for s, _, r in TARGETS}
    for r in copies:
        assert tokens[r.doc_id] == (r.source, r.n_tokens) and 1 <= r.copies <= limit[r.source]
        got[r.source] += r.copies * r.n_tokens
    report = {r.source: r for r in done.report.collect()}
    assert set(report) == listed
    for s, share, repeats in TARGETS:
        available = sum(t for x, t in tokens.values() if x == s)
        largest = max((t for x, t in tokens.values() if x == s), default=0)
        assert report[s].tokens == got[s] and report[s].available_tokens == available
        assert report[s].actual_share == pytest.approx(got[s] / sum(got.values()))
        if report[s].reachable:
            assert abs(got[s] - share * whole) <= largest
        else:
            assert got[s] == repeats * available < share * whole
    assert not report["small"].reachable and not report["missing"].reachable and report["a"].reachable
    again = {r.doc_id: r.copies for r in mix(sizes.repartition(7), targets).copies.collect()}
    assert again == {r.doc_id: r.copies for r in copies}


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    done = mix(none, targets)
    assert done.copies.count() == 0 and {r.tokens for r in done.report.collect()} == {0}
    some = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, n_tokens long")
    assert mix(some, targets.limit(0)).copies.count() == 0


def test_tilt_is_exponential(spark):
    """With a share below what there is, long documents lose more than short ones; equal documents have equal rates."""
    rows = [(i, "a", 10 if i % 2 else 100) for i in range(4000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    done = mix(sizes, spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int"))
    used = defaultdict(int)
    for r in done.copies.collect():
        used[r.n_tokens] += r.copies
    assert used[10] / 2000 > used[100] / 2000 > 0
    # rate = exp(dual * tokens): the logarithms are in proportion to the sizes.
    import math

    assert math.log(used[100] / 2000) / math.log(used[10] / 2000) == pytest.approx(10, rel=0.2)
