"""Observations of builds and queries as JSON lines, relevance judgements, and run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_OBSERVATION = "repetition int, codec string, executor string, k int, query_id string, status string, results int, nanoseconds long, query_terms long, matched_terms long, next_calls long, advance_calls long, block_headers_read long, blocks_skipped long, blocks_decoded long, postings_decoded long, bytes_requested long, candidates_scored long, pivot_selections long, threshold_changes long, digest string"
BUILD_OBSERVATION = "repetition int, codec string, documents long, tokens long, postings long, input_bytes long, index_bytes long, seconds double"
QRELS = "query_id string, iteration string, doc_id string, rel int"


def write_observations(df: DataFrame, path: str) -> None:
    """Write JSON lines to a path that doesn't exist yet."""
    df.write.mode("errorifexists").json(path)


def read_observations(spark: SparkSession, path: str, schema: str = QUERY_OBSERVATION) -> DataFrame:
    """Read JSON lines under a fixed schema; a line that doesn't fit it is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def same_results(observations: DataFrame) -> DataFrame:
    """(k, query_id, digests): queries whose results differ between codecs, executors or repetitions."""
    return observations.filter("status = 'ok'").groupBy("k", "query_id").agg(F.count_distinct("digest").alias("digests")).filter("digests > 1")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) of tab- or blank-separated judgements."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(3)).cast("int").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank) of a run file."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(3)).cast("int").alias("rank"))
