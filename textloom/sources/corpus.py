"""Corpora and query sets: TSV lines with ordinals, and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits of a record and of an external id in bytes (fixed values).
MAX_RECORD, MAX_ID = 1_048_576, 1_024


class RecordError(ValueError):
    """A corpus that holds a line which isn't a record."""


def _reason(line: Column) -> Column:
    at = F.locate("\t", line)
    id_bytes = F.octet_length(F.substring_index(line, "\t", 1))
    return (
        F.when(F.octet_length(line) > MAX_RECORD, "too_large")
        .when(~F.is_valid_utf8(line), "invalid_utf8")
        .when(at == 0, "column_count")
        .when(at == 1, "empty_id")
        .when(id_bytes > MAX_ID, "id_too_large")
    )


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines to records: adds external_id, text and reason (null for a record) and drops the line.

    One carriage return at the end is dropped; the first tab ends the id, later ones belong to
    the text; the text may be empty. A null line has the reason 'column_count'.
    """
    whole = F.coalesce(F.col(line), F.lit(""))
    # Bytes are cut, as functions on strings may replace what isn't UTF-8.
    bare = F.when(F.endswith(whole, F.lit("\r")), F.substring(whole.cast("binary"), F.lit(1), F.octet_length(whole) - 1).cast("string")).otherwise(whole)
    rows = lines.withColumn("_l", bare).withColumn("reason", _reason(F.col("_l"))).drop(line)
    good = F.col("reason").isNull()
    cut = rows.withColumn("external_id", F.when(good, F.substring_index("_l", "\t", 1)))
    return cut.withColumn("text", F.when(good, F.expr("substring(_l, length(external_id) + 2)"))).drop("_l")


def with_ordinal(lines: DataFrame) -> DataFrame:
    """Lines read from files with their dense 0-based place: by file path, then by place in the file.

    A split's first place is the number of lines before it, known from one count per split; the
    lines aren't shuffled. The rows must be as they were read.
    """
    row = F.monotonically_increasing_id()
    at = lines.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), row.alias("_m"))
    splits = at.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    # One row per split of a file, not per line.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("_f", "_b", "_m0", before.alias("_s"))
    return at.join(starts, ["_f", "_b"]).withColumn("ordinal", (F.col("_s") + F.col("_m") - F.col("_m0")).cast("long")).drop("_f", "_b", "_m", "_m0", "_s")


def read_tsv(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """(ordinal, external_id, text) of TSV files; lines end with a line feed only.

    Strict reading stops at the first line that is no record and names it; else the result also
    has the column reason, and such lines are rows with nulls.
    """
    rows = parsed(with_ordinal(spark.read.option("lineSep", "\n").text(path)))
    rows = rows.select("ordinal", "external_id", "text", "reason")
    if not strict:
        return rows
    bad = rows.filter(F.col("reason").isNotNull()).agg(F.min(F.struct("ordinal", "reason")).alias("b")).first().b
    if bad is not None:
        raise RecordError(f"record {bad.ordinal}: {bad.reason}")
    return rows.drop("reason")


def write_tsv(df: DataFrame, path: str, external: str = "external_id", text: str = "text") -> None:
    """Write records as TSV; line breaks within a text would break it and are refused."""
    bad = df.filter(F.col(external).isNull() | (F.length(external) == 0) | F.contains(F.col(external), F.lit("\t")) | F.col(external).rlike("[\n\r]") | F.col(text).rlike("[\n\r]")).limit(1).count()
    if bad:
        raise RecordError("an id or text can't be written as a line")
    df.select(F.concat_ws("\t", F.col(external), F.coalesce(F.col(text), F.lit("")))).write.option("lineSep", "\n").text(path)


def results_tsv(results: DataFrame) -> DataFrame:
    """Result lines 'query, external id, rank, score' in order of query and rank; scores in the shortest form that reads back."""
    score = F.col("score").cast("string")
    return results.select("query_id", "rank", F.concat_ws("\t", F.col("query_id").cast("string"), F.coalesce("external_id", F.lit("")), F.col("rank").cast("string"), score).alias("value")).orderBy("query_id", "rank").select("value")
