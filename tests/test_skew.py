"""Exact selection and lookups against plain Python, on skewed keys."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from textloom.operators.skew import keyed_profile, lookup_join


def brute(rows, fractions):
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    out = {}
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        out[k] = (len(vs), len(known), *[known[max(1, math.ceil(f * len(known))) - 1] if known else None for f in fractions])
    return out


def test_profile_of_skewed_keys(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", f"k{rng.randrange(50)}"]), rng.choice([None, rng.randrange(-5, 5), rng.randrange(-(2**62), 2**62), 2**63 - 1, -(2**63)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("rows", F.lit(1))
    fractions = (0.0, 0.5, 0.9, 1.0)
    found = keyed_profile(df, "k", "v", fractions)
    assert found.rounds == 8
    assert {r[0]: tuple(r[1:]) for r in found.frame.collect()} == brute(rows, fractions)


def test_profile_of_nothing_and_of_nulls(spark):
    assert keyed_profile(spark.createDataFrame([], "k string, v long"), "k", "v").frame.count() == 0
    df = spark.createDataFrame([("a", None), ("a", None), (None, 3)], "k string, v long")
    assert [tuple(r) for r in keyed_profile(df, "k", "v", (0.5,), sums=("v",)).frame.collect()] == [("a", 2, None, 0, None)]


def test_lookup_join_keeps_every_row(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"c{i % 40}", i) for i in range(900)] + [(None, -1), ("gone", -2)], "k string, i long")
    small = spark.createDataFrame([("hot", 600)] + [(f"c{i}", 8) for i in range(40)], "k string, n long")
    for how, more in (("inner", 0), ("left", 2)):
        out = lookup_join(big, small, "k", F.col("n") > 100, how).collect()
        assert len(out) == 900 + more
        assert all((r.n == 600) == (r.k == "hot") for r in out if r.i >= 0)
