"""Mixing sources to target shares by entropy balancing (problem 9)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import written

#: The table of targets is read to the driver; it has one row per source, and more than this is refused.
MOST_SOURCES = 10_000
TOLERANCE = 1e-9
ROUNDS = 60
#: Thresholds that one pass tries for each source, and the number of passes: 16**6 steps in all.
TRIED, PASSES = 16, 6


@dataclass
class Source:
    """One source while it is solved: its target, its sums, and the bracket of its dual variable."""

    name: str
    share: float
    repeats: int
    documents: int = 0
    tokens: int = 0
    target: float = 0.0
    dual: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    @property
    def mean(self) -> float:
        return self.tokens / self.documents if self.documents else 1.0

    @property
    def full(self) -> bool:
        """Even the most repeats don't reach the target."""
        return self.repeats * self.tokens <= self.target


def _parameters(df: DataFrame, sources: list[Source], values: dict[str, list[float]]) -> DataFrame:
    """A row of parameters per source joined to every row; the table is bounded by MOST_SOURCES."""
    names = [f"p{i}" for i in range(len(next(iter(values.values()))))]
    rows = [(s.name, *map(float, values[s.name])) for s in sources]
    small = df.sparkSession.createDataFrame(rows, "source string, " + ", ".join(f"{n} double" for n in names))
    return df.join(F.broadcast(small), "source")


def _rate(dual: Column, mean: Column, repeats: Column, tokens: Column) -> Column:
    """The tilted rate of a document, at most the repeats: exp(dual * tokens / mean), clipped."""
    return F.least(repeats, F.exp(F.least(F.lit(700.0), dual * tokens / mean)))


def _solve(hist: DataFrame, sources: list[Source]) -> int:
    """Newton's method on the dual for all sources at once: one aggregation per step, a row per source to the driver."""
    for s in sources:
        s.done = s.full or not s.tokens or s.target <= 0
        s.dual = 700.0 if s.full else -700.0 if s.target <= 0 else 0.0
    for step in range(1, ROUNDS + 1):
        left = [s for s in sources if not s.done]
        if not left:
            return step - 1
        rows = _parameters(hist, left, {s.name: [s.dual, s.mean, s.repeats] for s in left})
        raw = F.exp(F.least(F.lit(700.0), F.col("p0") * F.col("n_tokens") / F.col("p1")))
        rate = F.least(F.col("p2"), raw)
        # The derivative of a clipped rate is 0.
        sums = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens") * rate).alias("g"), F.sum(F.when(raw < F.col("p2"), F.col("n") * F.col("n_tokens") * rate * F.col("n_tokens") / F.col("p1")).otherwise(0.0)).alias("h"))
        found = {r.source: (r.g, r.h) for r in sums.collect()}
        for s in left:
            g, h = found[s.name]
            gap = g - s.target
            if abs(gap) <= TOLERANCE * s.target:
                s.done = True
                continue
            if gap < 0:
                s.low = s.dual
            else:
                s.high = s.dual
            new = s.dual - gap / h if h > 0 else math.inf
            if not s.low < new < s.high:
                # Outside the bracket: halve it, or double the step where it is open.
                if math.isfinite(s.low) and math.isfinite(s.high):
                    new = (s.low + s.high) / 2
                else:
                    new = s.dual + (1.0 if gap < 0 else -1.0) * max(1.0, abs(s.dual))
            if math.isfinite(s.low) and math.isfinite(s.high) and s.high - s.low < 1e-13 * max(1.0, abs(s.dual)):
                s.done = True
            s.dual = max(-700.0, min(700.0, new))
            if abs(s.dual) >= 700.0:
                s.done = True
    return ROUNDS


def _copies(shift: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col("p2"), F.floor(F.col("rate") + F.col("u") + shift))).cast("long")


def _round(rated: DataFrame, sources: list[Source]) -> dict[str, float]:
    """For each source the shift of its thresholds at which the rounded copies hold its tokens as closely as can be."""
    low = {s.name: -1.0 for s in sources}
    width = dict.fromkeys(low, 2.0)
    best: dict[str, tuple[float, float]] = {}
    by = {s.name: s for s in sources}
    for _ in range(PASSES):
        steps = _parameters(rated, sources, {s.name: [0, 0, s.repeats, low[s.name], width[s.name] / TRIED] for s in sources})
        sums = steps.groupBy("source").agg(*[F.sum(F.col("n_tokens") * _copies(F.col("p3") + F.lit(float(k)) * F.col("p4"))).alias(f"s{k}") for k in range(TRIED + 1)])
        for r in sums.collect():
            s = by[r.source]
            totals = [r[f"s{k}"] for k in range(TRIED + 1)]
            for k, t in enumerate(totals):
                at = low[s.name] + k * width[s.name] / TRIED
                if s.name not in best or abs(t - s.target) < best[s.name][0]:
                    best[s.name] = (abs(t - s.target), at)
            below = max((k for k, t in enumerate(totals) if t <= s.target), default=0)
            low[s.name] += min(below, TRIED - 1) * width[s.name] / TRIED
            width[s.name] /= TRIED
    return {name: at for name, (_, at) in best.items()}


@dataclass(frozen=True)
class Mixture:
    """copies: (doc_id, source, n_tokens, copies), documents used; report: one row per source; rounds of Newton's method."""

    copies: DataFrame
    report: DataFrame
    rounds: int


def mix(sizes: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 9) -> Mixture:
    """Choose copies of documents so that each source holds its share of ``fraction`` of all tokens.

    ``sizes`` has doc_id, source, n_tokens; ``targets`` source, target_share, max_repeats. Among
    all rates of documents that meet the token constraints and are at most max_repeats, those
    with the least relative entropy to "each document once" are exp(dual of its source *
    tokens), clipped at max_repeats. The convex dual is solved by Newton's method within a bracket;
    a step is one aggregation over the histogram of sizes. Rates become copies by
    randomised rounding with a hash of doc_id; a shift of the rounding, found by counting,
    makes the total meet the target to within about one document.

    A source that can't reach its target even with all repeats is taken whole, each document
    max_repeats times; the others keep their own targets, and the report has the actual
    shares. Repeated doc_ids count once; documents without tokens, with a null source or of
    a source without target are left out. A source without documents is in the report
    with 0 tokens. Null shares and repeats count as 0.
    """
    listed = [Source(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select("source", "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"]).limit(MOST_SOURCES + 1).collect()]
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = sizes.sparkSession
    base = sizes.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).filter("n_tokens > 0 and doc_id is not null").dropDuplicates(["doc_id"])
    names = spark.createDataFrame([(s.name,) for s in listed], "source string")
    base = written(base.join(F.broadcast(names), "source"), "sizes")
    hist = written(base.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")
    by = {s.name: s for s in listed}
    for r in hist.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect():
        by[r.source].documents, by[r.source].tokens = r.n, r.t
    whole = fraction * sum(s.tokens for s in listed)
    for s in listed:
        s.target = s.share * whole
    rounds = _solve(hist, listed) if listed else 0
    if listed:
        tilted = _parameters(base, listed, {s.name: [s.dual, s.mean, s.repeats] for s in listed})
        rate = _rate(F.col("p0"), F.col("p1"), F.col("p2"), F.col("n_tokens"))
        # 52 bits of a hash make a uniform number that is the same in every run.
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12).cast("double") / F.lit(float(2**52))
        rated = written(tilted.select("doc_id", "source", "n_tokens", rate.alias("rate"), u.alias("u")), "rates")
        shift = _round(rated, listed)
        done = _parameters(rated, listed, {s.name: [0, 0, s.repeats, shift.get(s.name, 0.0)] for s in listed})
        copies = written(done.select("doc_id", "source", "n_tokens", _copies(F.col("p3")).alias("copies")).filter("copies > 0"), "copies")
    else:
        copies = base.select("doc_id", "source", "n_tokens", F.lit(0).cast("long").alias("copies"))
    facts = spark.createDataFrame([(s.name, s.share, s.repeats, s.target, s.documents, s.tokens, not s.full or s.repeats * s.tokens == s.target) for s in listed], "source string, target_share double, max_repeats int, target_tokens double, documents long, available_tokens long, reachable boolean")
    used = copies.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    total = used.agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = facts.join(F.broadcast(used), "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), "target_tokens", zero("tokens"), "available_tokens", "documents", zero("used"), zero("copies"), zero("most_copies"), "max_repeats", "reachable")
    return Mixture(copies, report, rounds)
