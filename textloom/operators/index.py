"""The inverted index as tables: documents, postings, terms, shards, and one row of statistics.

Postings carry the length of their document, so ranking needs no join for it, and a
shard number, the document id without its last 16 bits. Joins by (term, shard) meet at
most 65,536 postings in a group, however frequent a term is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.analysis import PROFILES, terms
from textloom.operators.blocks import CODECS, posting_blocks
from textloom.session import written

SHARD_BITS = 16
FORMAT_VERSION = 1
MOST_DOCUMENTS = 2**32
TABLES = ("documents", "postings", "terms", "shards", "blocks")


@dataclass(frozen=True)
class Index:
    """documents (doc_id, external_id, length), postings (term, doc_id, tf, length, shard), terms (term, df, max_tf,
    cf), shards (term, shard, df), the profile its terms were made with, and the row of statistics, if it is written."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    shards: DataFrame
    profile: str
    facts: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        """One row: documents, documents_with_terms, total_length, average_length (0 for an index without terms)."""
        if self.facts is not None:
            return self.facts
        n = F.count_if(F.col("length") > 0)
        total = F.coalesce(F.sum("length"), F.lit(0)).cast("long")
        return self.documents.agg(F.count(F.lit(1)).alias("documents"), n.alias("documents_with_terms"), total.alias("total_length"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("average_length"))


def build(corpus: DataFrame, profile: str = "plain", key: str = "doc_id", external: str = "external_id", text: str = "text") -> Index:
    """Index a corpus (doc_id BIGINT, external_id, text), one row per document.

    Texts are analysed where they are read; their terms are shuffled once, by document, after which
    counting needs no further shuffle. Terms and shards are partial aggregates of the postings. Null and empty texts
    are documents of length 0. External ids may repeat or be null. Rows with a null key
    are left out. The result is lazy; see :func:`kept` and :func:`write`.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    rows = corpus.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(external).alias("external_id"), F.col(text).alias("text"))
    # Analysis comes before the shuffle: behind an Arrow function the optimiser no longer knows how rows are partitioned.
    analysed = rows.select("doc_id", "external_id", terms(F.col("text"), profile).alias("terms")).repartition("doc_id")
    documents = analysed.select("doc_id", "external_id", F.size("terms").cast("long").alias("length"))
    # The outer form, as for the other a filter on the terms would be derived and analyse every text twice.
    postings = analysed.select("doc_id", F.size("terms").cast("long").alias("length"), F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull()).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    return _derived(documents, postings.select("term", "doc_id", "tf", "length", F.shiftright("doc_id", SHARD_BITS).alias("shard")), profile)


def _derived(documents: DataFrame, postings: DataFrame, profile: str) -> Index:
    shards = _shards(postings)
    return Index(documents, postings, _dictionary(shards), shards.select("term", "shard", "df"), profile)


def _shards(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "shard").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.sum("tf").alias("cf"))


def _dictionary(shards: DataFrame) -> DataFrame:
    return shards.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.sum("cf").alias("cf"))


def kept(index: Index) -> Index:
    """The same index with all its tables written to the shared folder, read by all that follows.

    Lengths are taken from the written postings, so texts are analysed once; dictionary, shards
    and statistics are aggregated once.
    """
    postings = written(index.postings, "postings")
    lengths = postings.groupBy("doc_id").agg(F.first("length").alias("length"))
    documents = index.documents.select("doc_id", "external_id").join(lengths, "doc_id", "left").select("doc_id", "external_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    documents = written(documents, "documents")
    shards = written(_shards(postings), "shards")
    terms_ = written(_dictionary(shards), "terms")
    lazy = Index(documents, postings, terms_, shards.select("term", "shard", "df"), index.profile)
    return Index(documents, postings, terms_, lazy.shards, index.profile, written(lazy.stats, "stats"))


def merge(segments: list[Index]) -> Index:
    """One index of segments with distinct documents: postings are united, df and lengths add up, max_tf is the largest."""
    if not segments:
        raise ValueError("no segments")
    if len({s.profile for s in segments}) > 1:
        raise ValueError("segments were made with different profiles")
    documents, postings = segments[0].documents, segments[0].postings
    for s in segments[1:]:
        documents, postings = documents.unionByName(s.documents), postings.unionByName(s.postings)
    return _derived(documents, postings, segments[0].profile)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _rename(spark: SparkSession, a: str, b: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(a).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(a), path(b)):
        raise OSError(f"{a} could not be renamed to {b}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checksum(df: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order: number, and xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.x or 0:x}:{r.s or 0}"


def write(index: Index, path: str, codec: str = "vbyte") -> dict:
    """Write an index as Parquet tables and, last, its manifest; returns the manifest.

    The destination must not exist and appears only when the whole index is there. Postings
    are sorted by term and document, so that reads of a term skip all other row groups.
    """
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    spark = index.documents.sparkSession
    if _exists(spark, path):
        raise FileExistsError(path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        index = kept(index)
        layout = {
            "documents": index.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id"),
            "postings": index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"),
            "terms": index.terms.repartitionByRange("term").sortWithinPartitions("term"),
            "shards": index.shards.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard"),
            "blocks": posting_blocks(index.postings, codec).repartitionByRange("term", "block_no").sortWithinPartitions("term", "block_no"),
        }
        sums = {}
        for name, df in layout.items():
            df.write.parquet(f"{temporary}/{name}")
            sums[name] = checksum(spark.read.parquet(f"{temporary}/{name}"))
        manifest = {"format_version": FORMAT_VERSION, "profile": index.profile, "codec": codec, "checksums": sums}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{temporary}/manifest")
        _rename(spark, temporary, path)
    except BaseException:
        _delete(spark, temporary)
        raise
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a written index; unknown versions, profiles and codecs are refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"unsupported index version {manifest.get('format_version')!r}")
    if manifest.get("profile") not in PROFILES or manifest.get("codec") not in CODECS or set(manifest.get("checksums", {})) != set(TABLES):
        raise ValueError("unsupported index profile, codec or tables")
    return manifest


def open_index(spark: SparkSession, path: str) -> Index:
    """A written index; its tables are read when they are used."""
    manifest = read_manifest(spark, path)
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("documents", "postings", "terms", "shards")), manifest["profile"])


def index_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over version, profile, codec and the checksums of all tables: equal for equal content, however it is split into files."""
    import hashlib

    manifest = read_manifest(spark, path)
    parts = [str(manifest["format_version"]), manifest["profile"], manifest["codec"], *(f"{t}={manifest['checksums'][t]}" for t in TABLES)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def build_report(index: Index) -> DataFrame:
    """One row: documents, documents_with_terms, tokens, postings."""
    counted = index.postings.agg(F.count(F.lit(1)).alias("postings"))
    return index.stats.crossJoin(counted).select("documents", "documents_with_terms", F.col("total_length").alias("tokens"), "postings")
