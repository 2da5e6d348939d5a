"""Pairs within groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.skew import lookup_join
from textloom.session import written

#: Members of a group that may meet in one task; larger groups are cut into blocks that meet block by block.
BLOCK = 2_000
#: Groups with more than this share of all members learn their size where they are.
HOT_SHARE = 1e-3


def blocked(members: DataFrame, group: str, item: str, block: int = BLOCK, least: int = 1) -> DataFrame:
    """``members`` with its block ``i`` of the ``k`` blocks of its group, and whether the group has ``more`` than one; groups of fewer than ``least`` members are left out.

    Sizes come from mergeable counts and meet the members by :func:`lookup_join`, so that no
    group, however large, is shuffled to one task for it.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    total = max(1, members.count())
    cut = lookup_join(members, sizes, group, F.col("_n") > F.lit(HOT_SHARE * total))
    return cut.withColumn("k", F.ceil(F.col("_n") / F.lit(float(block))).cast("int")).withColumn("i", F.pmod(F.xxhash64(item), F.col("k")).cast("int")).withColumn("more", F.col("_n") > 1).drop("_n")


def group_pairs(members: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """(group, a, b) with a < b for each two members of a group; ``members`` has each (group, item) once.

    It is for results that are defined as pairs; its work is its output. A group of n
    members has ceil(n / block) blocks; each two blocks meet under their own key, so
    the work of a large group is spread evenly. Null groups and items have no pairs.
    """
    cut = blocked(members.select(F.col(group).alias("g"), F.col(item).alias("x")).dropna(), "g", "x", block, 2)
    return _within(cut).select(F.col("g").alias(group), "a", "b")


def _within(cut: DataFrame) -> DataFrame:
    left = cut.select("g", F.col("x").alias("l"), "i", F.explode(F.sequence("i", F.col("k") - 1)).alias("j"))
    right = cut.select("g", F.col("x").alias("r"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"))
    met = left.join(right, ["g", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("l") < F.col("r")))
    return met.select("g", F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))


def linked_pairs(links: DataFrame, members: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of items: each two members of a group, and each two of two groups that ``links`` (a, b) joins.

    Members of a large group lie in blocks; a link meets each block of either group under its own key.
    """
    cut = written(blocked(members.select(F.col(group).alias("g"), F.col(item).alias("x")).dropna(), "g", "x", block), "blocks")
    return across(links, cut).unionByName(_within(cut.filter("more")).select("a", "b"))


def across(links: DataFrame, cut: DataFrame) -> DataFrame:
    """(a, b), a < b, of items for links (a, b) of groups: the members of the one with the members of the other, block by block."""
    blocks = cut.select("g", "k").distinct()
    for side, name in (("a", "x"), ("b", "y")):
        links = links.join(blocks.select(F.col("g").alias(side), "k"), side).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
        links = links.join(cut.select(F.col("g").alias(side), "i", F.col("x").alias(name)), [side, "i"]).drop("i")
    return links.select(*[c for c in links.columns if c not in ("a", "b", "x", "y")], F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
