"""An index that grows with a stream: each micro-batch becomes a segment, segments are merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import Index, _derived, build, kept


def append_segments(stream: DataFrame, path: str, checkpoint: str, profile: str = "plain") -> StreamingQuery:
    """Index a stream of documents (doc_id, external_id, text) into segment tables below ``path``.

    A batch writes its documents and postings into folders named by its number and overwrites
    them if it runs again, so a batch counts once. Documents must be new; what arrives late is
    just a later segment, as statistics add up.
    """

    def add(batch: DataFrame, number: int) -> None:
        # Written once, so that a batch's texts are analysed once for both tables.
        index = kept(build(batch, profile))
        index.documents.write.mode("overwrite").parquet(f"{path}/documents/segment={number}")
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/segment={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_segments(spark: SparkSession, path: str, profile: str = "plain") -> Index:
    """The index of all segments: postings are united; dictionary, shards and statistics are sums over them."""
    documents = spark.read.parquet(f"{path}/documents").select("doc_id", "external_id", "length")
    postings = spark.read.parquet(f"{path}/postings").select("term", "doc_id", "tf", "length", "shard")
    return _derived(documents, postings, profile)


def late_counts(events: DataFrame, time: str, key: str, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Rows per key and window of a stream, rows later than ``delay`` behind the newest left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
