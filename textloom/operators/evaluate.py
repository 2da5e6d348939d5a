"""Retrieval quality, latency summaries, and sizes of segment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index


def reciprocal_rank(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, mrr. The mean over all queries of ``qrels`` (query_id, doc_id, rel); a query without a hit counts 0."""
    hits = run.filter(F.col("rank") <= k).join(qrels.filter("rel > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg((F.lit(1.0) / F.min("rank")).alias("rr"))
    return qrels.select("query_id").distinct().join(hits, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"))


def recall(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (10, 100)) -> DataFrame:
    """(k, queries, recall): the mean share of a query's relevant documents within its k first results."""
    relevant = qrels.filter("rel > 0").select("query_id", "doc_id").distinct()
    met = relevant.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    per = met.groupBy("query_id").agg(*[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"r{k}") for k in depths])
    mean = per.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(f"r{k}").alias(f"r{k}") for k in depths])
    return mean.select("queries", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in depths])).alias("x")).select("x.k", "queries", "x.recall")


def trec_run(results: DataFrame, tag: str) -> DataFrame:
    """(line): results as lines 'query Q0 document rank -rank tag'."""
    return results.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), (-F.col("rank")).cast("string"), F.lit(tag)).alias("line"))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """n, nearest-rank percentiles p50 ... and the largest value of each group; null values are left out."""
    kept = df.filter(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{p}") for p in percents], F.max(value).alias("max"))


def observation_summary(observations: DataFrame, by: tuple[str, ...] = ("repetition", "codec", "executor", "k"), counters: tuple[str, ...] = ()) -> DataFrame:
    """Per scenario: queries, failures, short results, sums of counters, seconds, rate and nearest-rank latencies.

    ``observations`` has status, results, k and nanoseconds; a short result is a good one with fewer than k rows.
    """
    ok = F.col("status") == "ok"
    latency = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY nanoseconds)").alias(f"p{p}_ns") for p in (50, 95, 99)]
    out = observations.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.count_if(~ok).alias("failures"), F.count_if(ok & (F.col("results") < F.col("k"))).alias("short_results"), *[F.sum(c).alias(c) for c in counters], (F.sum("nanoseconds") / 1e9).alias("seconds"), *latency, F.max("nanoseconds").alias("max_ns"))
    return out.withColumn("queries_per_second", F.col("queries") / F.col("seconds"))


def build_rates(builds: DataFrame) -> DataFrame:
    """Rates of build observations (documents, tokens, postings, input_bytes, index_bytes, seconds)."""
    per = lambda c: F.col(c) / F.col("seconds")
    return builds.select("*", per("documents").alias("documents_per_second"), per("tokens").alias("tokens_per_second"), per("postings").alias("postings_per_second"), (F.col("input_bytes") / 1048576.0 / F.col("seconds")).alias("input_mib_per_second"), (F.col("index_bytes") / F.col("postings")).alias("bytes_per_posting"))


#: Bytes of a run file besides its terms: header and terminator; of a term: its length and count; of a posting (fixed values).
RUN_FRAME, RUN_TERM, RUN_POSTING = 24, 12, 8


def run_bytes(index: Index, segment_documents: int) -> DataFrame:
    """(segment, bytes) of sorted runs of ``segment_documents`` consecutive document ids each."""
    seg = F.floor(F.col("doc_id") / segment_documents).cast("long").alias("segment")
    per_term = index.postings.groupBy(seg, "term").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_term.groupBy("segment").agg(F.sum(F.lit(RUN_TERM) + F.octet_length("term") + F.lit(RUN_POSTING) * F.col("n")).alias("b"))
    return index.documents.select(seg).distinct().join(sizes, "segment", "left").select("segment", (F.lit(RUN_FRAME) + F.coalesce("b", F.lit(0))).cast("long").alias("bytes"))


def merge_passes(runs: list[int], fan_in: int) -> list[list[list[int]]]:
    """The passes that merge runs in groups of ``fan_in``: per pass, the groups of run numbers; a group of one is carried over."""
    if fan_in < 2:
        raise ValueError("the fan-in must be at least 2")
    passes, left = [], len(runs)
    while left > 1:
        groups = [list(range(i, min(i + fan_in, left))) for i in range(0, left, fan_in)]
        passes.append(groups)
        left = len(groups)
    return passes


def segment_report(index: Index, segment_documents: int, fan_in: int = 16) -> DataFrame:
    """One row: what building in segments of consecutive documents and merging them would read and write.

    documents, documents_with_terms, tokens, postings, runs, merge_passes, merge_input_bytes and
    merge_output_bytes. A pass merges groups of ``fan_in`` neighbouring runs; a run that is left alone
    is carried over and counts in neither. One aggregation per pass, the number of which is the
    logarithm of the number of runs.
    """
    from textloom.operators.index import build_report

    if segment_documents < 1:
        raise ValueError("a segment has at least one document")
    level = run_bytes(index, segment_documents)
    runs = level.count()
    passes = merge_passes(list(range(runs)), fan_in)
    read = wrote = 0
    width = segment_documents
    for _ in passes:
        width *= fan_in
        grouped = level.groupBy(F.floor(F.col("segment") / fan_in).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
        level = run_bytes(index, width)
        sums = grouped.join(level.select(F.col("segment").alias("g"), F.col("bytes").alias("after")), "g").filter("n > 1").agg(F.sum("b").alias("i"), F.sum("after").alias("o")).first()
        read, wrote = read + (sums.i or 0), wrote + (sums.o or 0)
    facts = [F.lit(runs).cast("long").alias("runs"), F.lit(len(passes)).cast("long").alias("merge_passes"), F.lit(read).cast("long").alias("merge_input_bytes"), F.lit(wrote).cast("long").alias("merge_output_bytes")]
    return build_report(index).select("*", *facts)
