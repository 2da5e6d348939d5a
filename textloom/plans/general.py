"""Queries on the general problems: hot keys (4) and lines that fail (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.skew import keyed_profile
from textloom.session import spread, table
from textloom.sources.raw_records import failures, parse_lines, records

HOT_SHARE = 0.02


def term_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, df, bytes and exact quantiles of the bytes of every term of the dictionary."""
    rows = table(spark, sf_dir, "term_record").select("run_id", "term", "df", "postings_bytes").dropDuplicates(["run_id", "term"])
    return keyed_profile(rows, "term", "postings_bytes", (0.5, 0.9, 0.99), sums=("df", "postings_bytes")).frame


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that hold at least 2 % of the rows of the dictionary."""
    profile = term_profile(spark, sf_dir)
    total = profile.agg(F.sum("rows").alias("total"))
    return profile.join(F.broadcast(total), F.col("rows") >= F.lit(HOT_SHARE) * F.col("total")).select("term")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every term."""
    return term_profile(spark, sf_dir).select("term", "rows", F.col("sum_df").alias("df"), F.col("sum_postings_bytes").alias("postings_bytes"), "q50", "q90", "q99")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(spread(table(spark, sf_dir, "raw_record").select("line_no", "fmt", "line")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that give no record, with the first reason."""
    return failures(_parsed(spark, sf_dir)).distinct()


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all other lines."""
    return records(_parsed(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_profile": p4_profile, "p6_found": p6_found, "p6_records": p6_records}

#: Lines without the carriage return at their end, as hexadecimal digits and, where they are UTF-8, as text.
RAW_LINES = """raw AS (SELECT line_no, fmt, h, TRY(decode(unhex(h))) AS s FROM
 (SELECT line_no, fmt, CASE WHEN right(hex(line), 2) = '0D' THEN left(hex(line), len(hex(line)) - 2) ELSE hex(line) END AS h FROM raw_record))"""
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_TERMS = "SELECT run_id, term, any_value(df) AS df, any_value(postings_bytes) AS postings_bytes FROM term_record GROUP BY run_id, term"
_P6 = f"""WITH {RAW_LINES}, cut AS (SELECT *, regexp_extract(s, '^{_FIELD}', 0, 's') AS f FROM raw WHERE fmt = 'csv'),
 found AS (SELECT line_no, s, NULL AS f, CASE WHEN len(h) > 2 * 1048576 THEN 'too_large' WHEN s IS NULL THEN 'invalid_utf8' WHEN instr(s, chr(9)) = 0 THEN 'column_count' WHEN instr(s, chr(9)) = 1 THEN 'empty_id'
   WHEN strlen(split_part(s, chr(9), 1)) > 1024 THEN 'id_too_large' END AS reason FROM raw WHERE fmt = 'tsv'
  UNION ALL SELECT line_no, s, f, CASE WHEN len(h) > 2 * 1048576 THEN 'too_large' WHEN s IS NULL THEN 'invalid_utf8' WHEN NOT regexp_full_match(s, '{_FIELD}(?:,{_FIELD})*', 's') THEN 'broken_quoting'
   WHEN NOT regexp_full_match(s, '{_FIELD},{_FIELD}', 's') THEN 'column_count' WHEN f IN ('', '""') THEN 'empty_id'
   WHEN strlen(CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, len(f) - 2), '""', '"') ELSE f END) > 1024 THEN 'id_too_large' END FROM cut)"""


def _bare(field: str) -> str:
    return f"CASE WHEN {field} LIKE '\"%' THEN replace(substr({field}, 2, len({field}) - 2), '\"\"', '\"') ELSE {field} END"


SQL = {
    "p4_found": f"WITH t AS ({_TERMS}) SELECT term FROM t GROUP BY term HAVING count(*) >= 0.02 * (SELECT count(*) FROM t)",
    "p6_found": _P6 + " SELECT DISTINCT line_no, reason FROM found WHERE reason IS NOT NULL",
    "p6_records": _P6 + f", two AS (SELECT *, substr(s, len(f) + 2) AS g FROM found WHERE reason IS NULL) SELECT line_no, CASE WHEN f IS NULL THEN split_part(s, chr(9), 1) ELSE {_bare('f')} END AS external_id, CASE WHEN f IS NULL THEN substr(s, instr(s, chr(9)) + 1) ELSE {_bare('g')} END AS text FROM two",
    "p4_profile": f"""WITH t AS ({_TERMS}) SELECT term, count(*) AS "rows", CAST(sum(df) AS BIGINT) AS df, CAST(sum(postings_bytes) AS BIGINT) AS postings_bytes,
        quantile_disc(postings_bytes, 0.5) AS q50, quantile_disc(postings_bytes, 0.9) AS q90, quantile_disc(postings_bytes, 0.99) AS q99 FROM t GROUP BY term""",
}
