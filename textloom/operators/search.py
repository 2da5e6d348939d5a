"""Ranking of queries against an index.

A query is a set of terms; a document that holds any of them is a candidate; its score is
the sum of the BM25 contributions in ascending order of the terms. Results are ordered
by score descending, then document ascending. All queries are answered by one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import bm25
from textloom.functions.analysis import analyze, terms
from textloom.operators import grouped
from textloom.operators.blocks import BLOCK, HEADER, block_sizes, numbered, vbyte_size
from textloom.operators.index import Index
from textloom.session import shuffles_dropped, stored, written

EXECUTORS = ("exhaustive", "pruned")
#: Up to so many (query, term) rows, the plan of all queries is sent to every executor; beyond, it is joined by shuffles.
MOST_PLAN = 1_000_000
#: Rows of results that come from one plan.
MOST_ROWS = 15_000_000
#: Documents of a group that scores are summed up for at once: between 2**10 and 2**16.
GROUP_BITS = (10, 16)
#: Rounding slack of the pruning bound: bounds are summed in another order than scores.
SLACK = 1e-12


def prepared(queries: DataFrame, profile: str = "plain", key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term): the distinct terms of each query; a term that a query repeats counts once."""
    cut = queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.explode(terms(F.col(text), profile)).alias("term"))
    return cut.distinct()


def query_plan(index: Index, query_terms: DataFrame) -> DataFrame:
    """(query_id, term, df, max_tf, idf, bound, average): query terms that the dictionary holds, with their weights."""
    stats = index.stats.select(F.col("documents_with_terms").alias("n"), F.col("average_length").alias("average"))
    known = query_terms.join(index.terms.select("term", "df", "max_tf"), "term").crossJoin(F.broadcast(stats))
    weighed = known.withColumn("idf", bm25.idf(F.col("n"), F.col("df")))
    return weighed.withColumn("bound", bm25.upper_bound(F.col("idf"), F.col("max_tf"), F.col("average"))).select("query_id", "term", "df", "max_tf", "idf", "bound", "average")


def contributions(index: Index, plan: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, term, doc_id, c): what each posting of a query's terms adds. Meets by (term, shard)."""
    sharded = plan.join(index.shards.select("term", "shard"), "term")
    met = sharded.join(index.postings.select("term", "shard", "doc_id", "tf", "length"), ["term", "shard"])
    return met.select("query_id", "term", "doc_id", *extra, bm25.score(F.col("idf"), F.col("tf"), F.col("length"), F.col("average")).alias("c"))


def scored(parts: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of contributions; an array holds at most the terms of one query."""
    return parts.groupBy("query_id", "doc_id").agg(F.collect_list(F.struct("term", F.col("c").alias("value"))).alias("_p")).select("query_id", "doc_id", bm25.in_order(F.col("_p")).alias("score"))


def ranked(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k first documents of each query with their rank; a group limit prunes before and after the shuffle."""
    by = F.round("score", digits) if digits is not None else F.col("score")
    order = Window.partitionBy("query_id").orderBy(by.desc(), F.col("doc_id").asc())
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _group_best(offsets: np.ndarray, used: np.ndarray, essential: np.ndarray, mask: int, k: int, margin: float):
    """What a task does for a group of documents: scores of all queries, and each query's k best.

    Only documents of a query's essential lists are candidates; all lists count for their scores.
    """
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        group = int(table.column("g")[0].as_py())
        number, doc, c = (np.asarray(table.column(x)) for x in ("number", "doc_id", "c"))
        order = np.argsort(number, kind="stable")
        number, place, c = number[order], (doc[order] & mask).astype(np.int64), c[order]
        heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        ends = np.append(heads[1:], len(number))
        lists = {int(number[a]): (place[a:b], c[a:b]) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)}
        total = np.zeros(mask + 1)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in range(len(offsets) - 1):
            a, b = offsets[q], offsets[q + 1]
            own = [lists[t] for t in used[a:b].tolist() if t in lists]
            from_ = [lists[t][0] for t in used[a:b][essential[a:b]].tolist() if t in lists]
            if not from_:
                continue
            # Lists come in ascending order of the terms, and a document is once in a list: the order of sums is kept.
            for at, add in own:
                total[at] += add
            held = from_[0] if len(from_) == 1 else np.unique(np.concatenate(from_))
            score = total[held]
            for at, _ in own:
                total[at] = 0.0
            if len(held) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k] - margin
                held, score = held[keep], score[keep]
            found.append((q, held, score))
        size = [len(h) for _, h, _ in found]
        queries = np.repeat(np.array([q for q, _, _ in found], np.int64), size)
        docs = np.concatenate([h for _, h, _ in found]) + group * (mask + 1) if found else np.zeros(0, np.int64)
        return pa.table({"number": pa.array(queries), "doc_id": pa.array(docs.astype(np.int64)), "score": pa.array(np.concatenate([s for _, _, s in found]) if found else np.zeros(0))})

    return run


def _essential(rows: pd.DataFrame, theta: dict, margin: float) -> np.ndarray:
    """Which rows (query_id, bound) are essential: without them, no document reaches its query's threshold.

    Of each query's terms in ascending order of their bounds, those whose bounds add up to less than
    the threshold are not: a document that holds only such terms scores less.
    """
    if not theta:
        return np.ones(len(rows), bool)
    least = rows["query_id"].map(theta).fillna(-1.0).astype(float).to_numpy() - margin
    order = np.lexsort((rows["bound"].to_numpy(), pd.factorize(rows["query_id"])[0]))
    sums = rows.iloc[order].groupby("query_id", sort=False)["bound"].cumsum()
    need = np.empty(len(rows), bool)
    need[order] = sums.to_numpy() * (1.0 + SLACK) >= least[order]
    return need


def dense_best(index: Index, plan: DataFrame, k: int, digits: int | None = None, theta: dict | None = None) -> DataFrame | None:
    """(query_id, doc_id, score) with at least the k best documents of each query, or None if the plan is too large.

    Contributions don't depend on the query, so they are computed once per posting, in the JVM.
    Postings of the asked terms are shuffled by groups of neighbouring documents; within a group,
    scores of each query are summed in an array, term after term in ascending order, and only its k
    best leave the task (all of equal score). A group has at most 65,536 documents. ``theta`` has
    scores that each query's k-th best reaches; documents that can't reach them aren't candidates.
    """
    rows = plan.select("query_id", "term", "bound").limit(MOST_PLAN + 1).toPandas()
    if len(rows) > MOST_PLAN:
        return None
    spark = index.documents.sparkSession
    id_type = plan.schema["query_id"].dataType.simpleString()
    if rows.empty:
        return spark.createDataFrame([], f"query_id {id_type}, doc_id long, score double")
    words = sorted(set(rows["term"]), key=lambda t: t.encode())
    number = {t: i for i, t in enumerate(words)}
    codes, names = pd.factorize(rows["query_id"])
    terms_ = rows["term"].map(number).to_numpy()
    order = np.lexsort((terms_, codes))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(names)))))
    asked = spark.createDataFrame(list(enumerate(words)), "number int, term string")
    weights = plan.groupBy("term").agg(F.first("idf").alias("idf"), F.first("average").alias("average")).join(F.broadcast(asked), "term")
    met = index.postings.select("term", "doc_id", "tf", "length").join(F.broadcast(weights), "term")
    biggest = index.documents.agg(F.max("doc_id").alias("m")).first().m or 0
    wanted = max(1, (biggest + 1) // (4 * spark.sparkContext.defaultParallelism))
    bits = min(max(wanted.bit_length() - 1, GROUP_BITS[0]), GROUP_BITS[1])
    parts = met.select(F.shiftright("doc_id", bits).alias("g"), "number", "doc_id", bm25.score(F.col("idf"), F.col("tf"), F.col("length"), F.col("average")).alias("c"))
    margin = 0.0 if digits is None else 2.0 * 10.0**-digits
    essential = _essential(rows, theta or {}, margin)
    best = parts.groupBy("g").applyInArrow(_group_best(offsets, terms_[order], essential[order], (1 << bits) - 1, k, margin), "number long, doc_id long, score double")
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(names.tolist())], f"number long, query_id {id_type}")
    return best.join(F.broadcast(ids), "number").select("query_id", "doc_id", "score")


def pruned_best(index: Index, plan: DataFrame, k: int, digits: int | None = None) -> DataFrame | None:
    """As :func:`dense_best`, with fewer candidates: each query's term of highest idf gives a first threshold."""
    first = Window.partitionBy("query_id").orderBy(F.col("idf").desc(), F.col("term").asc())
    rarest = plan.withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i")
    lower = dense_best(index, rarest, k)
    if lower is None or plan.limit(MOST_PLAN + 1).count() > MOST_PLAN:
        return None
    reached = ranked(lower, k).filter(F.col("rank") == k).select("query_id", "score").collect()  # a row per query of a bounded plan
    return dense_best(index, plan, k, digits, {r.query_id: r.score for r in reached})


def pruned_parts(index: Index, plan: DataFrame, k: int) -> DataFrame:
    """Contributions of documents that may be among the k best of their query.

    The partial scores by each query's term of highest idf are lower bounds of scores; their k-th
    is a threshold. A document whose bounds, summed over the query's terms that it holds, lie below
    it can't be among the k best, and isn't scored. The result of the ranking is the same.
    """
    first = Window.partitionBy("query_id").orderBy(F.col("idf").desc(), F.col("term").asc())
    essential = plan.withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i")
    lower = ranked(contributions(index, essential).select("query_id", "doc_id", F.col("c").alias("score")), k)
    threshold = lower.filter(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    parts = contributions(index, plan, ("bound",))
    grouped = parts.groupBy("query_id", "doc_id").agg(F.sum("bound").alias("_b"), F.collect_list(F.struct("term", F.col("c").alias("value"))).alias("_p"))
    alive = grouped.join(threshold, "query_id", "left").filter(F.col("theta").isNull() | (F.col("_b") >= F.col("theta") * F.lit(1.0 - SLACK)))
    return alive.select("query_id", "doc_id", "_p")


def search(index: Index, queries: DataFrame, k: int = 10, executor: str = "exhaustive", digits: int | None = None, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, external_id, score): the k best documents of every query.

    Queries without a known term have no rows; k < 1 gives none at all. External ids are
    joined to the winners only. ``digits`` ranks by rounded scores, for comparison with
    engines that sum in another order.
    """
    if executor not in EXECUTORS:
        raise ValueError(f"unknown executor {executor!r}")
    plan = query_plan(index, prepared(queries, index.profile, key, text))
    plan = written(plan, "plan")
    if executor == "exhaustive":
        b = grouped.batch(index, plan, MOST_PLAN)
        if b is not None:
            return resolve(index, grouped_winners(index, b, k, digits))
        scores = scored(contributions(index, plan))
    else:
        scores = pruned_best(index, plan, max(k, 1), digits)
        if scores is None:
            scores = pruned_parts(index, plan, max(k, 1)).select("query_id", "doc_id", bm25.in_order(F.col("_p")).alias("score"))
    return resolve(index, ranked(scores, k, digits))


def grouped_winners(index: Index, b: grouped.Batch, k: int, digits: int | None = None) -> DataFrame:
    """The k first documents of each query of a batch with their rank.

    A first pass over the groups finds a score for each query that k documents reach; the second gives the documents that
    reach it. Results of more than ``MOST_ROWS`` rows are written, queries by queries, so that shuffle files can go.
    """
    spark = index.documents.sparkSession
    with shuffles_dropped(spark):
        theta = grouped.thresholds(index, b, max(k, 1)) if b.names else np.zeros(0)
    n = len(b.names)
    parts = -(-n * max(k, 1) // MOST_ROWS)
    if parts <= 1:
        return ranked(grouped.best(index, b, max(k, 1), theta, digits, 0, n), k, digits)
    path, schema = None, None
    for i in range(parts):
        some = ranked(grouped.best(index, b, max(k, 1), theta, digits, n * i // parts, n * (i + 1) // parts), k, digits)
        with shuffles_dropped(spark):
            path, schema = stored(some, "winners", to=path), some.schema
    return spark.read.schema(schema).parquet(path)


def resolve(index: Index, results: DataFrame) -> DataFrame:
    """The results with the external ids of their documents."""
    return results.join(index.documents.select("doc_id", "external_id"), "doc_id").select("query_id", "rank", "doc_id", "external_id", "score")


def search_one(index: Index, text: str, k: int = 10, executor: str = "exhaustive", digits: int | None = None) -> DataFrame:
    """(rank, doc_id, external_id, score) of one query; its terms become literals, which are pushed to the scan."""
    if executor not in EXECUTORS:
        raise ValueError(f"unknown executor {executor!r}")
    words = sorted(set(analyze(text, index.profile)))
    spark = index.documents.sparkSession
    part = Index(index.documents, index.postings.filter(F.col("term").isin(words)), index.terms.filter(F.col("term").isin(words)), index.shards.filter(F.col("term").isin(words)), index.profile, index.facts)
    rows = spark.createDataFrame([(0, w) for w in words], "query_id int, term string")
    plan = query_plan(part, rows)
    if executor == "exhaustive":
        # A row per word of one query: it is sent to the postings, which stay where they are until they are partial sums.
        met = part.postings.select("term", "doc_id", "tf", "length").join(F.broadcast(plan), "term")
        scores = scored(met.select("query_id", "term", "doc_id", bm25.score(F.col("idf"), F.col("tf"), F.col("length"), F.col("average")).alias("c")))
    else:
        scores = pruned_parts(part, plan, max(k, 1)).select("query_id", "doc_id", bm25.in_order(F.col("_p")).alias("score"))
    return resolve(index, ranked(scores, k, digits)).drop("query_id")


def _asked(index: Index, plan: DataFrame) -> DataFrame:
    """The postings of a plan's terms alone; they meet by (term, shard), as a term may be frequent."""
    return index.postings.join(plan.select("term").distinct().join(index.shards.select("term", "shard"), "term"), ["term", "shard"], "left_semi")


def _union_rows(g: int, group: grouped.Group, order: np.ndarray | None, table) -> dict:
    """A group's share in each query's candidates."""
    query, n = grouped.unions(group)
    some = n > 0
    return {"q": query[some], "n": n[some]}


def candidate_counts(index: Index, plan: DataFrame) -> DataFrame:
    """(query_id, candidates): the documents that hold any of a query's terms."""
    b = grouped.batch(index, plan, MOST_PLAN)
    if b is None:
        return contributions(index, plan).select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))

    def run(g: int, group: grouped.Group, order: np.ndarray | None, table):
        import pyarrow as pa

        return pa.table(_union_rows(g, group, order, table))

    return grouped.named(grouped.over_groups(index, b, run, "q long, n long").groupBy("q").agg(F.sum("n").alias("candidates")), b)


def union_work(index: Index, queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, candidates, postings) of exhaustive evaluation, without the sizes of blocks."""
    asked = written(prepared(queries, index.profile, key, text), "asked")
    plan = written(query_plan(index, asked), "plan")
    out = asked.select("query_id").distinct().join(plan.groupBy("query_id").agg(F.sum("df").alias("postings")), "query_id", "left").join(candidate_counts(index, plan), "query_id", "left")
    return out.select("query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "postings")])


def _counts_and_bytes(index: Index, plan: DataFrame, codec: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, candidates) and (term, bytes), from one shuffle of the asked postings."""
    b = grouped.batch(index, plan, MOST_PLAN)
    if b is None:
        per_term = block_sizes(_asked(index, plan)).groupBy("term").agg(F.sum(F.col(f"{codec}_bytes") + HEADER).alias("bytes"))
        return candidate_counts(index, plan), per_term

    def run(g: int, group: grouped.Group, order: np.ndarray | None, table):
        import pyarrow as pa

        counts = _union_rows(g, group, order, table)
        lists = grouped.list_sizes(group, g, BLOCK)
        ends, starts = lists.pop("starts")
        a, c = len(counts["q"]), len(lists["n"])
        wide = lambda v, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(v.astype(np.int64)), pa.nulls(after, pa.int64())])
        columns = {"q": wide(counts["q"], 0, c), "n": pa.array(np.concatenate([counts["n"], lists["n"]]))} | {x: wide(lists[x], a, 0) for x in ("number", "first", "last", "inner")}
        offsets = np.concatenate([np.zeros(a, np.int32), ends.astype(np.int32)])
        return pa.table(columns | {"starts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts.astype(np.int32)))})

    with shuffles_dropped(index.documents.sparkSession):
        found = written(grouped.over_groups(index, b, run, "q long, n long, number long, first long, last long, inner long, starts array<int>").withColumn("list", F.col("q").isNull()), "lists")
    counts = grouped.named(found.filter("not list").groupBy("q").agg(F.sum("n").alias("candidates")), b)
    # Lists of a term in ascending groups: what came before decides where blocks begin, and from where the first gap counts.
    behind = Window.partitionBy("number").orderBy("first")
    lists = found.filter("list").withColumn("_before", F.coalesce(F.sum("n").over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % BLOCK).withColumn("_last", F.lag("last").over(behind))
    first = vbyte_size(F.when(F.col("_before") == 0, F.col("first")).otherwise(F.col("first") - F.col("_last")))
    begun = F.coalesce(F.get("starts", ((BLOCK - F.col("_before")) % BLOCK).cast("int")), F.lit(0))
    size = F.col("inner") + first + begun if codec == "vbyte" else F.col("n") * 8
    words = index.documents.sparkSession.createDataFrame(list(enumerate(b.words)), "number long, term string")
    per_term = lists.groupBy("number").agg((F.sum(size) + F.ceil(F.sum("n") / BLOCK) * HEADER).alias("bytes")).join(words, "number").select("term", "bytes")
    return counts, per_term


def exhaustive_work(index: Index, queries: DataFrame, codec: str = "vbyte", key: str = "query_id", text: str = "text") -> DataFrame:
    """The work of exhaustive evaluation per query: query_terms, matched_terms, postings_decoded, candidates, blocks_decoded, bytes.

    The rest follows: next_calls = postings_decoded, block_headers_read = blocks_decoded; no
    advances, skips, pivots or threshold changes.
    """
    asked = written(prepared(queries, index.profile, key, text), "asked")
    plan = written(query_plan(index, asked), "plan")
    union, per_term = _counts_and_bytes(index, plan, codec)
    work = plan.join(per_term, "term").groupBy("query_id").agg(F.count(F.lit(1)).alias("matched_terms"), F.sum("df").alias("postings_decoded"), F.sum(F.ceil(F.col("df") / BLOCK)).alias("blocks_decoded"), F.sum("bytes").alias("bytes"))
    total = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("query_terms"))
    out = total.join(work, "query_id", "left").join(union, "query_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched_terms", "postings_decoded", "candidates", "blocks_decoded", "bytes")]
    return out.select("query_id", "query_terms", *zero)


def _pruning_counts(index: Index, plan: DataFrame, b: grouped.Batch, k: int) -> DataFrame:
    """(query_id, exhaustive, pruned) from groups: documents that hold a term, and those whose bounds reach the threshold."""
    first = Window.partitionBy("query_id").orderBy(F.col("idf").desc(), F.col("term").asc())
    rarest = plan.withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i")
    lower = grouped.batch(index, rarest, MOST_PLAN)
    with shuffles_dropped(index.documents.sparkSession):
        reached = grouped_winners(index, lower, k).filter(F.col("rank") == k).select("query_id", "score").toPandas()  # a row per query of a bounded plan
    theta = dict(zip(reached["query_id"], reached["score"], strict=True))
    # Without a threshold, every document that holds a term counts.
    least = np.array([theta[q] * (1.0 - SLACK) if q in theta else 5e-324 for q in b.names])

    def run(g: int, group: grouped.Group, order: np.ndarray | None, table):
        import pyarrow as pa

        query, n = grouped.unions(group)
        reaching = grouped.group_reaching(group, group.b.bound[group.number], least)
        some = n > 0
        return pa.table({"q": query[some], "exhaustive": n[some], "pruned": reaching[some]})

    sums = grouped.over_groups(index, b, run, "q long, exhaustive long, pruned long").groupBy("q").agg(F.sum("exhaustive").alias("exhaustive"), F.sum("pruned").alias("pruned"))
    return grouped.named(sums, b).select("query_id", "exhaustive", "pruned")


def pruning_work(index: Index, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, exhaustive, pruned): candidates scored by either executor."""
    plan = written(query_plan(index, prepared(queries, index.profile, key, text)), "plan")
    b = grouped.batch(index, plan, MOST_PLAN)
    if b is not None:
        return _pruning_counts(index, plan, b, k)
    count = lambda df, c: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(c))
    return count(scored(contributions(index, plan)), "exhaustive").join(count(pruned_parts(index, plan, k), "pruned"), "query_id")


# --- counters of the document-at-a-time evaluation with pivots ---------------------

COUNTERS = ("query_terms", "matched_terms", "next_calls", "advance_calls", "block_headers_read", "blocks_skipped", "blocks_decoded", "postings_decoded", "bytes_requested", "candidates_scored", "pivot_selections", "threshold_changes")


class _List:
    """A posting list with the costs of moving in it."""

    def __init__(self, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, size: np.ndarray, idf: float, bound: float) -> None:
        self.doc, self.tf, self.length, self.size, self.idf, self.bound = doc, tf, length, size, idf, bound
        self.at, self.block = 0, 0
        self.count = dict.fromkeys(COUNTERS, 0)
        self._open(0)

    def _open(self, block: int) -> None:
        self.block = block
        n = min(BLOCK, len(self.doc) - block * BLOCK)
        self.count["block_headers_read"] += 1
        self.count["blocks_decoded"] += 1
        self.count["postings_decoded"] += n
        self.count["bytes_requested"] += HEADER + int(self.size[block])

    @property
    def ended(self) -> bool:
        return self.at >= len(self.doc)

    def next(self) -> None:
        self.count["next_calls"] += 1
        self.at += 1
        if not self.ended and self.at // BLOCK != self.block:
            self._open(self.at // BLOCK)

    def advance(self, target: int) -> None:
        self.count["advance_calls"] += 1
        if self.ended or self.doc[self.at] >= target:
            return
        last = min((self.block + 1) * BLOCK, len(self.doc)) - 1
        if self.doc[last] < target:
            blocks = -(-len(self.doc) // BLOCK)
            block = self.block + 1
            while block < blocks and self.doc[min((block + 1) * BLOCK, len(self.doc)) - 1] < target:
                self.count["block_headers_read"] += 1
                self.count["blocks_skipped"] += 1
                self.count["bytes_requested"] += HEADER
                block += 1
            if block == blocks:
                self.at = len(self.doc)
                return
            self._open(block)
        self.at = max(self.at, int(np.searchsorted(self.doc, target)))


def pivot_evaluation(lists: list[_List], k: int, average: float) -> tuple[list[tuple[int, float]], dict[str, int]]:
    """Evaluate one query with score bounds; ``lists`` in ascending order of the terms. Gives the k best and the counters."""
    best: list[tuple[float, int]] = []
    done = dict.fromkeys(COUNTERS, 0)
    done["matched_terms"] = len(lists)
    while k > 0:
        live = sorted((i for i, x in enumerate(lists) if not x.ended), key=lambda i: (int(lists[i].doc[lists[i].at]), i))
        if not live:
            break
        here = int(lists[live[0]].doc[lists[live[0]].at])
        if len(best) == k:
            chosen: list[int] = []
            pivot = None
            for i in live:
                chosen.append(i)
                if sum(lists[j].bound for j in sorted(chosen)) > best[-1][0]:
                    pivot = int(lists[i].doc[lists[i].at])
                    break
            if pivot is None:
                break
            done["pivot_selections"] += 1
            if pivot != here:
                before = [i for i in chosen if int(lists[i].doc[lists[i].at]) < pivot]
                lists[max(before, key=lambda i: (lists[i].idf, -before.index(i)))].advance(pivot)
                continue
        score = 0.0
        for x in lists:
            if not x.ended and int(x.doc[x.at]) == here:
                score += bm25.py_score(x.idf, int(x.tf[x.at]), int(x.length[x.at]), average)
                x.next()
        done["candidates_scored"] += 1
        old = best[-1][0] if len(best) == k else None
        best = sorted([*best, (score, here)], key=lambda r: (-r[0], r[1]))[:k]
        if len(best) == k and best[-1][0] != old:
            done["threshold_changes"] += 1
    for x in lists:
        for name, n in x.count.items():
            done[name] += n
    return [(d, s) for s, d in best], done


def pivot_work(index: Index, queries: DataFrame, k: int = 10, codec: str = "vbyte", key: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, 12 counters) of the evaluation with pivots, replayed per query.

    It is a cost model, not the way to answer queries: a query's lists lie in one task, in
    compressed rows of one (term, block) each.
    """
    asked = written(prepared(queries, index.profile, key, text), "asked")
    plan = written(query_plan(index, asked), "plan")
    lists = _asked(index, plan)
    blocks = numbered(lists).groupBy("term", "block_no").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("p")).join(block_sizes(lists).select("term", "block_no", F.col(f"{codec}_bytes").alias("size")), ["term", "block_no"])
    total = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_terms"))
    met = total.join(plan.join(blocks, "term"), "query_id", "left")
    id_type = asked.schema["query_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lists = []
        for _, rows in group.dropna(subset=["term"]).sort_values(["term", "block_no"]).groupby("term", sort=True):
            flat = [x for p in rows["p"] for x in p]
            column = lambda c: np.array([x[c] for x in flat], np.int64)  # noqa: B023, E731
            lists.append(_List(column("doc_id"), column("tf"), column("length"), rows["size"].to_numpy(), float(rows["idf"].iloc[0]), float(rows["bound"].iloc[0])))
        average = float(group["average"].dropna().iloc[0]) if lists else 0.0
        _, done = pivot_evaluation(lists, k, average)
        done["query_terms"] = int(group["_terms"].iloc[0])
        return pd.DataFrame([{"query_id": group["query_id"].iloc[0], **done}])

    return met.groupBy("query_id").applyInPandas(run, f"query_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTERS))


def digests(results: DataFrame) -> DataFrame:
    """(query_id, results, sha256) over rank order, documents, external ids and the bits of scores."""
    import hashlib
    import struct

    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "external_id", "score"))).alias("r"))

    @F.pandas_udf(results.schema["external_id"].dataType)
    def digest(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in lists:
            out = []
            for rows in series:
                h = hashlib.sha256(b"results-1" + struct.pack("<Q", len(rows)))
                for x in rows:
                    name = (x["external_id"] or "").encode()
                    h.update(struct.pack("<QQ", x["doc_id"], len(name)) + name + struct.pack("<d", x["score"]))
                out.append(h.hexdigest())
            yield pd.Series(out)

    return listed.select("query_id", F.size("r").alias("results"), digest("r").alias("sha256"))
