"""How distinctive a term is of a record (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import terms_col
from textloom.operators.skew import lookup_join

#: Terms held by at least this share of the records are looked up in a broadcast table. A record with d distinct terms
#: adds d to the sum of all df, so there are at most d / COMMON such terms for records of d distinct terms on average.
COMMON = 0.005


def joint_counts(records: DataFrame, key: str = "ordinal", text: str = "text") -> DataFrame:
    """(key, term, tf): how often each record uses each term. Rows repeated in a key count once.

    The texts are shuffled by key; exploding and counting then need no further shuffle.
    """
    once = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])
    return once.select("_key", F.explode(terms_col(F.col("_text"))).alias("term")).groupBy("_key", "term").agg(F.count(F.lit(1)).alias("tf"))


def pmi_weights(joint: DataFrame, marginals: DataFrame, n_records: Column | int, alpha: float = 0.75, positive: bool = True, by_tf: bool = False) -> DataFrame:
    """(_key, term, tf, df, pmi, weight) from joint counts (_key, term, tf) and marginals (term, df).

    pmi = ln(p(r | t) / p_alpha(r)). Given the term, its records are equally likely, p(r | t) =
    1 / df. The context count of record r is the sum of its tf, smoothed by the exponent:
    p_alpha(r) = size(r)**alpha / sum of size**alpha over all records. alpha = 1 is plain PMI,
    0.75 the usual smoothing; at alpha = 0 every record is as likely, p(r) = 1 / N, and pmi =
    ln(N / df). ``positive`` replaces negative values by 0; ``by_tf`` weighs by the joint count,
    weight = tf * pmi, which at alpha = 0 is tf * ln(N / df).

    Group-bys and joins only. The join by term keeps rows of common terms where they are.
    A term without marginal count is left out, as nothing is known of it.
    """
    n = F.lit(n_records) if isinstance(n_records, int) else n_records
    known = lookup_join(joint, marginals.select("term", "df"), "term", F.col("df") >= F.lit(COMMON) * n)
    if alpha == 0:
        shaped = known.withColumn("_p", F.lit(1.0) / n)
    else:
        sizes = joint.groupBy("_key").agg(F.pow(F.sum("tf").cast("double"), F.lit(alpha)).alias("_s"))
        total = sizes.agg(F.sum("_s").alias("_total"))
        shaped = known.join(sizes, "_key").crossJoin(F.broadcast(total)).withColumn("_p", F.col("_s") / F.col("_total")).drop("_s", "_total")
    # ln(N / df) is written as such at alpha = 0, so that rounding meets the usual form.
    ratio = n / F.col("df") if alpha == 0 else F.lit(1.0) / F.col("df") / F.col("_p")
    pmi = F.log(ratio)
    pmi = F.greatest(F.lit(0.0), pmi) if positive else pmi
    return shaped.withColumn("pmi", pmi).withColumn("weight", F.col("tf") * F.col("pmi") if by_tf else F.col("pmi")).drop("_p")


def most_distinctive(weights: DataFrame, n: int = 3, digits: int = 6) -> DataFrame:
    """The ``n`` terms of each record with the highest weight, rounded; ties by the term's bytes."""
    rounded = weights.withColumn("weight", F.round("weight", digits))
    order = Window.partitionBy("_key").orderBy(F.col("weight").desc(), F.col("term").asc())
    return rounded.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
