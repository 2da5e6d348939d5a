"""BM25 as columns; the order of operations is part of the result."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of the ranking (fixed values).
K1, B = 0.9, 0.4


def idf(n: Column, df: Column) -> Column:
    """log1p((N - df + 0.5) / (df + 0.5)); N counts documents that have a term."""
    return F.log1p(((n - df) + F.lit(0.5)) / (df + F.lit(0.5)))


def score(idf_: Column, tf: Column, length: Column, average: Column) -> Column:
    """The contribution of one term to one document."""
    norm = F.lit(1.0 - B) + F.lit(B) * (length / average)
    return idf_ * ((tf * F.lit(K1 + 1.0)) / (tf + F.lit(K1) * norm))


def upper_bound(idf_: Column, max_tf: Column, average: Column) -> Column:
    """No document gets more from a term: a document is at least as long as the term is frequent in it."""
    return score(idf_, max_tf, max_tf, average)


def in_order(parts: Column) -> Column:
    """The sum of an array of structs (term, value) in ascending order of the term, so that its bits don't depend on the plan."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda a, x: a + x["value"])


def py_idf(n: int, df: int) -> float:
    return math.log1p(((n - df) + 0.5) / (df + 0.5))


def py_score(idf_: float, tf: int, length: int, average: float) -> float:
    norm = (1.0 - B) + B * (length / average)
    return idf_ * ((tf * (K1 + 1.0)) / (tf + K1 * norm))
