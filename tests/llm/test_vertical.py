import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.functions.text import terms_of
from textloom.llm import vertical as V


@pytest.mark.parametrize("n", [1, 5, 4095, 4096, 40_000, 65_536])
def test_containers(n):
    rng = np.random.default_rng(n)
    places = np.sort(rng.choice(65_536, n, replace=False))
    for counts in (np.ones(n, np.int64), rng.integers(1, 200, n), rng.integers(1, 2**33, n)):
        ids, packed = V.pack(places, counts)
        assert V.cardinality(ids) == n and len(ids) <= V.BITMAP_BYTES
        a, b = V.unpack(ids, packed)
        assert (a == places).all() and (b == counts).all()


@pytest.mark.parametrize("seed", range(4))
def test_union(seed):
    rng = random.Random(seed)
    parts, want = [], {}
    for _ in range(rng.randrange(1, 6)):
        own = {rng.randrange(65_536): rng.choice([1, 1, 7, 300]) for _ in range(rng.choice([1, 50, 9000]))}
        if seed == 3:
            own = dict.fromkeys(own, 1)
        keys = sorted(own)
        parts.append(V.pack(np.array(keys), np.array([own[k] for k in keys])))
        for k, v in own.items():
            want[k] = max(v, want.get(k, 0))
    a, b = V.unpack(*V.union(parts))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want


def brute(rows):
    tf, docs = defaultdict(dict), set()
    for k, t in rows:
        if k is not None:
            c = Counter(terms_of(t))
            if c:
                docs.add(k)
            for w, n in c.items():
                tf[w][k] = n
    return {w: (len(d), sum(d.values())) for w, d in tf.items()}, len(docs)


def test_frequencies(spark, monkeypatch):
    rng = random.Random(2)
    words = ["hot", "Hot", "can't", "rock’n", "Über", "x²", "日本", *[f"w{i}" for i in range(300)]]
    rows = [(rng.choice([i, -i, i << 20, i << 40]), None if i % 50 == 0 else "hot " * (i % 3) + " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(1500)]
    rows = list({k: (k, t) for k, t in rows}.values())
    rows += rows[:400] + [(None, "lost"), (10**15, ""), (10**15 + 1, " -- ")]
    df = spark.createDataFrame(rows, "page_id long, text string").repartition(5)
    want, n = brute(rows)
    got = {r.term: (r.records, r.occurrences) for r in V.frequencies(V.of_texts(df, "page_id", "text")).collect()}
    assert got.pop(V.ANY) == (n, n)
    assert got == want
    total = spark.createDataFrame([(n,)], "n long")
    marks = {r.term: r.mark for r in V.marked(V.frequencies(V.of_texts(df, "page_id", "text")), "records", total).collect()}
    assert marks == {w: "rare" if d < 3 else "common" if d > 0.2 * n else None for w, (d, _) in want.items()}


def test_flushes_in_between():
    import pyarrow as pa

    old, V.HELD = V.HELD, 10
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 70_000, 1]), pa.array(["a b c d e f a", "a b c d e f", "a", "a b c d e f a"])], names=["k", "t"])
        out = [r for b in V._from_texts(iter([batch, batch])) for r in b.to_pylist()]
        assert len(out) > 7
        rows = sorted(out, key=lambda r: (r["term"], r["part"]))
        merged = [r for b in V._merged(iter(pa.RecordBatch.from_pylist(rows[i : i + 3], schema=V._SCHEMA) for i in range(0, len(rows), 3))) for r in b.to_pylist()]
        a = {r["part"]: V.unpack(r["ids"], r["counts"]) for r in merged if r["term"] == "a"}
        assert a[0][0].tolist() == [1, 2] and a[0][1].tolist() == [2, 1] and a[1][0].tolist() == [70_000 - 65_536]
    finally:
        V.HELD = old


def test_counts_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 2, 5), ("b", 9, 1), (None, 1, 1), ("c", None, 1), ("d", 1, None)], "term string, run_id long, df long")
    got = {r.term: (r.records, r.occurrences) for r in V.frequencies(V.of_counts(df, "term", "run_id", "df")).collect()}
    assert got == {"a": (2, 7), "b": (1, 1)}
    assert V.frequencies(V.of_texts(spark.createDataFrame([], "k long, t string"), "k", "t")).count() == 0
