"""Checks of a whole index: each gives the number of its violations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.blocks import BLOCK, decode
from textloom.operators.index import MOST_DOCUMENTS, SHARD_BITS, TABLES, Index, checksum, open_index, read_manifest

MAX_ID, MAX_TERM = 1_024, 1_048_576


def _row(name: str, df: DataFrame, count) -> DataFrame:
    return df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def violations(index: Index) -> DataFrame:
    """(check, violations) for every invariant of documents, dictionary and postings; an empty index has none."""
    d, p, t, s = index.documents, index.postings, index.terms, index.shards
    dense = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("u"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    per_doc = p.groupBy("doc_id").agg(F.sum("tf").alias("total"), F.max("length").alias("l1"), F.min("length").alias("l2"))
    per_term = p.groupBy("term").agg(F.count(F.lit(1)).alias("df2"), F.max("tf").alias("max2"), F.sum("tf").alias("cf2"))
    per_shard = p.groupBy("term", "shard").agg(F.count(F.lit(1)).alias("df2"))
    joined = per_term.join(t, "term", "full_outer")
    checks = [
        _row("document_ids_distinct", dense, F.max(F.col("n") - F.col("u"))),
        _row("document_ids_in_range", d, F.count_if((F.col("doc_id") < 0) | (F.col("doc_id") >= MOST_DOCUMENTS))),
        _row("external_ids", d, F.count_if((F.octet_length("external_id") < 1) | (F.octet_length("external_id") > MAX_ID) | ~F.is_valid_utf8("external_id"))),
        _row("lengths", d, F.count_if(F.col("length").isNull() | (F.col("length") < 0))),
        _row("terms_distinct", t.groupBy("term").agg(F.count(F.lit(1)).alias("c")), F.sum(F.col("c") - 1)),
        _row("terms", t, F.count_if((F.octet_length("term") < 1) | (F.octet_length("term") > MAX_TERM) | ~F.is_valid_utf8("term"))),
        _row("term_counts_in_range", t.crossJoin(F.broadcast(n)), F.count_if((F.col("df") < 1) | (F.col("df") > F.col("n")) | (F.col("max_tf") < 1))),
        _row("dictionary_of_postings", joined, F.count_if(F.col("df").isNull() | F.col("df2").isNull())),
        _row("term_counts", joined, F.count_if((F.col("df") != F.col("df2")) | (F.col("max_tf") != F.col("max2")) | (F.col("cf") != F.col("cf2")))),
        _row("shards", per_shard.join(s, ["term", "shard"], "full_outer"), F.count_if(~F.col("df").eqNullSafe(F.col("df2")))),
        _row("postings_distinct", p.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c")), F.sum(F.col("c") - 1)),
        _row("postings_frequencies", p, F.count_if((F.col("tf") < 1) | (F.col("tf") > F.col("length")))),
        _row("postings_shards", p, F.count_if(F.col("shard") != F.shiftright("doc_id", SHARD_BITS))),
        _row("postings_documents", p.join(d, "doc_id", "left_anti"), F.count(F.lit(1))),
        _row("document_totals", d.join(per_doc, "doc_id", "left"), F.count_if((F.coalesce("total", F.lit(0)) != F.col("length")) | (F.col("l1") != F.col("length")) | (F.col("l2") != F.col("length")))),
    ]
    return reduce(DataFrame.unionByName, checks)


def block_violations(index: Index, blocks: DataFrame, codec: str) -> DataFrame:
    """(check, violations) of encoded blocks: they decode, are in order and hold exactly the postings."""

    def run(batches):
        for batch in batches:
            docs, tfs, at, bad = [], [], [], []
            for i, (n, last, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "last_doc_id", "payload")), strict=True)):
                try:
                    d, f = decode(payload, codec)
                    wrong = len(d) != n or not 1 <= n <= BLOCK or int(d[-1]) != last or bool((d[1:] <= d[:-1]).any()) or bool((f < 1).any())
                except ValueError:
                    wrong = True
                if wrong:
                    bad.append(i)
                else:
                    docs.append(d)
                    tfs.append(f)
                    at.append(np.full(len(d), i))
            flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            rows = np.concatenate([flat(at), np.array(bad, np.int64)])
            none, good = pa.nulls(len(bad), pa.int64()), len(rows) - len(bad)
            columns = [pa.concat_arrays([pa.array(flat(x)), none]) for x in (docs, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(rows)), *columns, pa.array(np.arange(len(rows)) >= good)], names=["term", "doc_id", "tf2", "bad"])

    rows = blocks.select("term", "n", "last_doc_id", "payload").mapInArrow(run, "term string, doc_id long, tf2 long, bad boolean")
    order = blocks.withColumn("_b", F.lag("last_doc_id").over(Window.partitionBy("term").orderBy("block_no"))).withColumn("_n", F.lag("block_no").over(Window.partitionBy("term").orderBy("block_no")))
    met = rows.filter("not bad").join(index.postings.select("term", "doc_id", "tf"), ["term", "doc_id"], "full_outer")
    checks = [
        _row("blocks_decode", rows, F.count_if("bad")),
        _row("blocks_in_order", order, F.count_if((F.col("_b") >= F.col("last_doc_id")) | (F.col("block_no") != F.coalesce(F.col("_n") + 1, F.lit(0))))),
        _row("blocks_hold_postings", met, F.count_if(~F.col("tf").eqNullSafe(F.col("tf2")))),
    ]
    return reduce(DataFrame.unionByName, checks)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(check, violations) of a written index: manifest, checksums, and all invariants."""
    manifest = read_manifest(spark, path)
    index = open_index(spark, path)
    rows = [(f"checksum_{t}", int(checksum(spark.read.parquet(f"{path}/{t}")) != manifest["checksums"][t])) for t in TABLES]
    sums = spark.createDataFrame(rows, "check string, violations long")
    return sums.unionByName(violations(index)).unionByName(block_violations(index, spark.read.parquet(f"{path}/blocks"), manifest["codec"]))
