"""The forest against all pairs."""

import random
import time
from pathlib import Path

import pyarrow as pa
import pytest

from textloom.functions.text import terms_of
from textloom.llm import lshforest as S
from textloom.session import shared_dir


def corpus(seed, n=250, boiler=0.3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    common = [" ".join(rng.choices(vocab, k=6)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = " ".join(rng.choice(common) if rng.random() < boiler else " ".join(rng.choices(vocab, k=4)) for _ in range(rng.randrange(4, 30))).split()
        rows.append((i, words))
    for i in range(n, 2 * n):
        words = list(rng.choice(rows)[1])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            k = rng.randrange(len(words))
            op = rng.random()
            if op < 0.4:
                words[k] = rng.choice(vocab)
            elif op < 0.7:
                words.insert(k, rng.choice(vocab))
            else:
                words = words[k:] + words[:k]
        rows.append((i, words))
    return [(i, None if rng.random() < 0.1 else "Title", " ".join(w)) for i, w in rows]


def brute(rows, size, threshold, least):
    sets = {}
    for k, title, text in rows:
        w = terms_of((title or "") + " " + (text or ""))
        if k is not None and len(w) >= max(least, size):
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}, set(sets)


@pytest.mark.parametrize(("seed", "size", "threshold", "least"), [(1, 3, 0.5, 20), (2, 5, 0.8, 0)])
def test_recall_and_precision(spark, seed, size, threshold, least):
    rows = corpus(seed)
    rows += rows[:30] + [(None, "x", rows[0][2]), (9001, None, None), (9002, "", ""), (9003, "short", "text")]
    df = spark.createDataFrame(rows, "page_id long, title string, text string")
    found = S.near_duplicates(df, "page_id", ["title", "text"], (), size, threshold, least)
    got = [tuple(r) for r in found.pairs().collect()]
    want, eligible = brute(rows, size, threshold, least)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want) > 50
    groups = {r.key: (r.group, r.links) for r in found.groups().collect()}
    assert set(groups) == eligible
    up = {k: k for k in eligible}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in got:
        up[root(a)] = root(b)
    assert len({root(k) for k in eligible}) == len({g for g, _ in groups.values()})
    assert all(groups[a][0] == groups[b][0] for a, b in got)


def test_crowded_regions_lose_nothing(spark):
    """Many texts that differ in one word: more than a region holds at any depth."""
    base = [f"b{i}" for i in range(400)]
    rows = [(i, "t", " ".join([*base[:200], f"x{i}", *base[200:]])) for i in range(60)] + [(100 + i, "t", " ".join(base)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, title string, text string")
    found = S.near_duplicates(df, "page_id", ["title", "text"], (), 3, 0.5, 20)
    assert found.pairs().count() == 80 * 79 // 2
    assert {r.links for r in found.groups().collect()} == {60}


@pytest.mark.parametrize(("direct", "window"), [(S.DIRECT, S.WINDOW), (16, S.WINDOW), (16, 70)])
def test_large_groups_near_the_threshold(spark, direct, window):
    """160 texts with a common part and own words, at similarities between 0.5 and 0.6: all pairs are candidates."""
    core = [f"c{i}" for i in range(120)]
    rows = [(i, "t", " ".join([*core, *(f"o{i}x{j}" for j in range(42 + i % 12))])) for i in range(160)]
    df = spark.createDataFrame(rows, "page_id long, title string, text string")
    texts = S.features(df, "page_id", ["title", "text"], 3, 20, ())
    want, _ = brute(rows, 3, 0.5, 20)
    assert len(want) == 160 * 159 // 2
    assert S.candidates(texts, 0.5, direct, window).count() == len(want)


def test_templates_give_few_candidates(spark):
    """400 pairs of texts from one template, of which 60 % are the same: candidates grow with the pairs, not with the square of the template."""
    rng = random.Random(5)
    template, own = [f"t{i}" for i in range(120)], lambda: [f"w{rng.randrange(20_000)}" for _ in range(80)]
    rows = []
    for i in range(400):
        words = [*template, *own()]
        rows += [(2 * i, "t", " ".join(words)), (2 * i + 1, "t", " ".join([*words[:150], "edit", *words[151:]]))]
    df = spark.createDataFrame(rows, "page_id long, title string, text string")
    texts = S.features(df, "page_id", ["title", "text"], 3, 20, ())
    assert 400 <= S.candidates(texts, 0.5, 100).count() <= 4_000
    pairs = {tuple(r) for r in S.near_duplicates(df, "page_id", ["title", "text"], (), 3, 0.5, 20).pairs().collect()}
    assert pairs == {(2 * i, 2 * i + 1) for i in range(400)}


def test_rare_shingles_lose_nothing(spark):
    """The way of crowded regions alone, on all texts, against all pairs."""
    rows = [(i, "t", t) for i, _, t in corpus(7, 120)]
    df = spark.createDataFrame(rows, "page_id long, title string, text string")
    made = S.features(df, "page_id", ["title", "text"], 3, 20, ()).collect()
    key = {}
    for r in made:
        key.setdefault(bytes(r.digest), r.key)
    texts = spark.createDataFrame([(r.digest, r.hashes) for r in made if r.hashes is not None], "digest binary, hashes binary").dropDuplicates(["digest"])
    for block in (S.BLOCK, 20):
        got = {tuple(sorted((key[bytes(a)], key[bytes(b)]))) for a, b in S.rare_first(texts, 0.5, block=block).collect()}
        want = {p for p in brute(rows, 3, 0.5, 20)[0] if set(p) <= set(key.values())}
        assert want <= got and len(want) > 50


def test_windows_cut_nowhere(spark):
    rows = [(i, "t", t) for i, _, t in corpus(3, 120)]
    df = spark.createDataFrame(rows, "page_id long, title string, text string")
    texts = S.features(df, "page_id", ["title", "text"], 3, 20, ()).dropDuplicates(["digest"])
    pair = lambda w: {tuple(map(bytes, r)) for r in S.candidates(texts, 0.5, window=w).collect()}
    whole, cut = pair(100_000), pair(70)
    assert whole <= cut


def test_nothing_and_very_long(spark):
    df = spark.createDataFrame([], "page_id long, title string, text string")
    found = S.near_duplicates(df, "page_id", ["title", "text"], (), 3, 0.5, 20)
    assert found.pairs().count() == 0 and found.groups().count() == 0
    long = " ".join(f"v{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, None, long), (2, "a", long), (3, "", "v1 v2")], "page_id long, title string, text string")
    assert [tuple(r) for r in S.near_duplicates(df, "page_id", ["title", "text"], ()).pairs().collect()] == [(1, 2)]


def test_components_of_long_paths(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(120) if i != 60]
    got = {bytes(r.digest): bytes(r.label) for r in S.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert set(got.values()) == {b"000", b"061"} and len(got) == 121


def test_rows_behind_a_cut_window_stay_with_their_group():
    """A group fills a window and leaves a few rows behind: all of it is grouped again by the same further values."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("further", pa.binary())])
    row = lambda key, i: {"key": key, "digest": i.to_bytes(16, "big"), "sketch": bytes(S.SKETCH_BYTES), "further": bytes(S.FURTHER)}
    rows = [row(1, i) for i in range(5)] + [row(2, i) for i in range(5, 105)] + [row(3, 105), row(3, 106), row(4, 107)]
    batches = [pa.RecordBatch.from_pylist(rows[a:b], schema=schema) for a, b in ((0, 5), (5, 95), (95, 108))]
    found = pa.Table.from_batches(list(S._walk(S.agreement_needed(0.5), 16, 90)(iter(batches)))).to_pylist()
    groups: dict[int, set[int]] = {}
    for r in found:
        if r["key"] is not None:
            groups.setdefault(r["key"], set()).add(int.from_bytes(r["a"], "big"))
    assert sum(members == set(range(5, 105)) for members in groups.values()) == S.FURTHER
    assert [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in found if r["key"] is None] == [(105, 106)]


def test_crowded_groups_go_deeper_where_they_lie():
    """300 texts share their first value and, by fours, the next ones, but not what follows: none is left to the way of rare shingles."""
    rng = random.Random(11)
    schema = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("further", pa.binary())])
    rows = []
    for i in range(302):
        further = bytes(rng.randrange(4) for _ in range(8))
        sketch = bytearray(further + rng.randbytes(S.SKETCH_BYTES - 8))
        key = 1 if i == 0 else 3 if i == 301 else 2
        rows.append({"key": key, "digest": i.to_bytes(16, "big"), "sketch": bytes(sketch), "further": further[: S.FURTHER]})
    rows[200] |= {"sketch": rows[100]["sketch"], "further": rows[100]["further"]}
    found = pa.Table.from_batches(list(S._walk(S.agreement_needed(0.5), 16, 100_000)(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])))).to_pylist()
    inner = {r["a"] for r in found if r["key"] is not None} & {r["digest"] for r in rows[1:301]}
    assert not inner
    assert [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in found if r["key"] is None] == [(100, 200)]


def test_disk_is_given_back(spark):
    """What near_duplicates leaves on disk, shuffle files included, is members and links, not the sets and orders they came from."""
    rows = corpus(9, 300)
    df = spark.createDataFrame(rows, "page_id long, title string, text string").repartition(4)
    shared = Path(shared_dir(spark).removeprefix("file://"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = blocks.getAllFiles()
        shuffles = sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))
        return shuffles + sum(p.stat().st_size for p in shared.rglob("*.parquet"))

    sets = 5 * sum(r.n for r in S.features(df, "page_id", ["title", "text"], 3, 20, ()).dropDuplicates(["digest"]).select("n").collect())
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    before = held()
    found = S.near_duplicates(df, "page_id", ["title", "text"], (), 3, 0.5, 20)
    end = time.time() + 30
    while held() - before > 0.7 * sets and time.time() < end:  # files are removed soon after the action
        time.sleep(0.5)
    assert held() - before <= 0.7 * sets
    assert found.pairs().count() > 50
