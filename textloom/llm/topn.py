"""The N best results of every query (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(results: DataFrame, n: int = 10, group: str = "query_id", score: str = "score", ties: tuple[str, ...] = ("external_id", "doc_id"), key: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """The ``n`` rows of each group with the highest score, with their place ``place`` from 1.

    row_number over (group by score descending, then ``ties`` ascending) with a filter on
    it. The optimiser turns this into a group limit before the shuffle by group, so a
    group of any size sends at most n rows per task. Rows delivered again (equal in group,
    ``key``, score and ties) are merged first, by a shuffle on all of these, under which no
    group is heavy.

    Null and NaN scores are left out; 0.0 and -0.0 are the same number; a null tie value
    comes last, strings are ordered by their UTF-8 bytes; a null group is a group. A
    group with fewer rows gives all of them. n < 1 gives no rows. Other columns are dropped.
    """
    columns = list(dict.fromkeys([group, *key, *ties]))
    valid = results.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(*columns, (F.col(score) + F.lit(0.0)).alias(score))
    once = valid.dropDuplicates()
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
