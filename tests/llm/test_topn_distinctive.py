import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textloom.functions.text import terms_of
from textloom.llm.distinctive import joint_counts, most_distinctive, pmi_weights
from textloom.llm.topn import top_n


def test_top_n(spark):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        q = "hot" if rng.random() < 0.4 else rng.choice(["a", "A", None, f"q{rng.randrange(200)}"])
        rows.append((q, i, rng.choice(["x", "é", "X", None, f"e{i}"]), rng.choice([None, float("nan"), 1.0, 1.0 + 1e-15, -0.0, 0.0, rng.random()]), i % 7))
    rows += rng.choices(rows, k=1500)
    df = spark.createDataFrame(rows, "query_id string, doc_id long, external_id string, score double, place int")
    by = defaultdict(set)
    for q, d, e, s, _ in rows:
        if s is not None and not math.isnan(s):
            by[q].add((-(s + 0.0), e is None, (e or "").encode(), d))
    want = {q: [x[3] for x in sorted(v)[:10]] for q, v in by.items()}
    got = defaultdict(list)
    for r in top_n(df, 10).orderBy("place").collect():
        got[r.query_id].append(r.doc_id)
    assert got == want
    assert top_n(df, 0).count() == 0 and top_n(df.limit(0), 3).count() == 0


def test_group_limit_is_in_the_plan(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0)], "query_id string, doc_id long, external_id string, score double")
    plan = top_n(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


TEXTS = ["apple Apple pear", "apple", None, "", "--", "pear fig fig fig", "apple fig", "kiwi"] + ["apple"] * 30


def test_weights(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (None, "kiwi", "x")]
    df = spark.createDataFrame(rows, "ordinal long, text string, term string")
    joint = joint_counts(df)
    counts = {i: Counter(terms_of(t)) for i, t in enumerate(TEXTS) if terms_of(t)}
    assert {(r._key, r.term): r.tf for r in joint.collect()} == {(i, t): n for i, c in counts.items() for t, n in c.items()}
    df_of = Counter(t for c in counts.values() for t in c)
    del df_of["kiwi"]
    marginals = spark.createDataFrame([*df_of.items()], "term string, df long")
    n = len(counts)
    plain = {(r._key, r.term): r.weight for r in pmi_weights(joint, marginals, n, 0, False, True).collect()}
    assert plain == {(i, t): c[t] * math.log(n / df_of[t]) for i, c in counts.items() for t in c if t in df_of}
    sizes = {i: sum(c.values()) ** 0.75 for i, c in counts.items()}
    total = sum(sizes.values())
    smooth = {(r._key, r.term): r.weight for r in pmi_weights(joint, marginals, n, 0.75).collect()}
    for (i, t), w in smooth.items():
        assert math.isclose(w, max(0.0, math.log(1 / df_of[t] / (sizes[i] / total))), abs_tol=1e-12)
    assert len(smooth) == len(plain)
    best = defaultdict(list)
    for r in most_distinctive(pmi_weights(joint, marginals, n, 0, False, True), 2).orderBy("place").collect():
        best[r._key].append(r.term)
    for i, c in counts.items():
        ranked = sorted(((-round(c[t] * math.log(n / df_of[t]), 6), t.encode(), t) for t in c if t in df_of))
        assert best.get(i, []) == [t for *_, t in ranked[:2]]


def test_no_records(spark):
    joint = joint_counts(spark.createDataFrame([], "ordinal long, text string"))
    assert pmi_weights(joint, spark.createDataFrame([("x", 1)], "term string, df long"), 0, 0).count() == 0
    long = spark.createDataFrame([(1, "w " * 200_000)], "ordinal long, text string")
    assert joint_counts(long).first().tf == 200_000
    assert joint_counts(long.withColumn("tf", F.lit(1))).count() == 1
