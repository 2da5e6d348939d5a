"""Lookups and per-key results that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import written

#: A key is hot if it holds more than this share of the counted values; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1e-4


def lookup_join(big: DataFrame, small: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """Join ``big`` (any number of rows per key) with ``small`` (one row per key).

    ``hot`` is a condition on ``small``'s columns that holds for a bounded number of
    keys, e.g. for those with more than a fixed share of the rows. Their rows of
    ``small`` are broadcast, so that rows of ``big`` with a hot key stay where they are;
    the other rows are shuffled by the key, of which none is heavy. Rows of ``big`` with
    a null key find no partner. Columns besides ``key`` must not clash.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    marked = small.withColumn("_hot", F.coalesce(hot, F.lit(False)))
    few, many = (marked.filter(c).drop("_hot") for c in (F.col("_hot"), ~F.col("_hot")))
    names = F.broadcast(few.select(F.col(key).alias("_k")))
    at_home = big.join(F.broadcast(few), key, "inner")
    away = big.join(names, F.col(key) == F.col("_k"), "left_anti").join(many, key, how)
    return at_home.unionByName(away)


@dataclass(frozen=True)
class Selection:
    """What :func:`keyed_profile` found: one row per key."""

    frame: DataFrame
    rounds: int


def keyed_profile(df: DataFrame, key: str, value: str, fractions: Sequence[float] = (0.5, 0.9, 0.99), sums: Sequence[str] = (), bits: int = 8) -> Selection:
    """Rows, sums and exact quantiles of ``value`` for each ``key``, without a heavy task.

    Distributed exact selection. Each round counts, for each key, the rows of every
    bin of a histogram (a groupBy with partial aggregation: mergeable counts), finds for
    each wanted rank the bin that holds it, and goes on only within that bin, with bins
    2**bits times finer, until a bin is one value. No values of a key are ever gathered;
    a task holds counts of bins. The rows of a hot key are spread over all tasks in
    every round, as only counts are shuffled by key.

    ``value`` is a whole number; rank r of fraction f among n values is ceil(f * n),
    at least 1, counted from 1 (the discrete quantile). Null values count as rows
    but not for quantiles; a key without values has null quantiles. Null keys are left
    out. Ties need no rule, equal values being one value. An empty table gives no rows.

    Result: key, rows, sum_<s> for each of ``sums``, n_values, q<percent> for each fraction.
    """
    if not fractions or any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("fractions must lie between 0 and 1")
    base = df.filter(F.col(key).isNotNull())
    # Equal (key, value) pairs become one counted row; the rounds read this table.
    pairs = written(base.groupBy(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s_{s}") for s in sums]), "profile")
    edge = pairs.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    width = max(1, (edge.hi - edge.lo).bit_length()) if edge.lo is not None else 1
    shift = (-(-width // bits) - 1) * bits

    # Round one: the coarse histogram of every key gives rows, sums and the wanted ranks.
    first = written(pairs.groupBy("k", F.shiftright("v", shift).alias("b")).agg(F.sum("n").alias("n"), *[F.sum(f"s_{s}").alias(f"s_{s}") for s in sums]), "histogram")
    totals = first.groupBy("k").agg(F.sum("n").alias("rows"), *[F.sum(f"s_{s}").alias(f"sum_{s}") for s in sums], F.sum(F.when(F.col("b").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("n_values"))
    rank = lambda f: F.greatest(F.lit(1), F.ceil(F.lit(float(f)) * F.col("n_values"))).cast("long")
    ranks = totals.filter("n_values > 0").select("k", F.posexplode(F.array(*[rank(f) for f in fractions])).alias("q", "rank"))
    # A key has at most 2**bits + 1 bins in a round, so the bins of a key may lie in one array.
    listed = F.array_sort(F.collect_list(F.struct("b", "n"))).alias("bins")
    state = _choose(first.filter("b is not null").groupBy("k").agg(listed).join(ranks, "k"))
    rounds, values = 1, max(1, totals.agg(F.sum("n_values").alias("n")).first().n or 0) if shift > 0 else 1
    while shift > 0:
        state = written(state, "ranks")
        wide, shift, rounds = shift, shift - bits, rounds + 1
        # Only rows of the bins in question count; a bin asked for by several ranks counts once.
        asked = state.join(totals.select("k", "n_values"), "k").groupBy(F.struct("k", F.col("b").alias("p")).alias("kp")).agg(F.first("n_values").alias("n_values"))
        # A bin of a hot key may hold nearly all of its different values: they are counted where they are.
        tagged = lookup_join(pairs.filter("v is not null").withColumn("kp", F.struct("k", F.shiftright("v", wide).alias("p"))), asked, "kp", F.col("n_values") > F.lit(HOT_SHARE * values)).withColumn("p", F.col("kp.p"))
        fine = tagged.groupBy("k", "p", F.shiftright("v", shift).alias("b")).agg(F.sum("n").alias("n"))
        state = _choose(fine.groupBy("k", "p").agg(listed).join(state.select("k", F.col("b").alias("p"), "q", "rank"), ["k", "p"]))
    names = [f"q{f * 100:g}".replace(".", "_") for f in fractions]
    values = state.groupBy("k").agg(*[F.max(F.when(F.col("q") == i, F.col("b"))).alias(n) for i, n in enumerate(names)])
    out = totals.join(values, "k", "left").select(F.col("k").alias(key), "rows", *[f"sum_{s}" for s in sums], "n_values", *names)
    return Selection(out, rounds)


def _choose(ranked: DataFrame) -> DataFrame:
    """For rows (k, q, rank, bins sorted by b): the bin that holds the rank, and the rank within it."""
    start = F.struct(F.lit(None).cast("long").alias("b"), F.col("rank").cast("long").alias("left"))
    found = F.aggregate(
        "bins",
        start,
        lambda a, x: F.when(a["b"].isNotNull(), a).when(x["n"] >= a["left"], F.struct(x["b"].alias("b"), a["left"].alias("left"))).otherwise(F.struct(F.lit(None).cast("long").alias("b"), (a["left"] - x["n"]).alias("left"))),
    )
    return ranked.withColumn("f", found).select("k", "q", F.col("f.b").alias("b"), F.col("f.left").alias("rank"))
