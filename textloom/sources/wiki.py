"""Wiki dumps (an action line and an article line in turn) and catalogs of display metadata."""

from __future__ import annotations

from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.corpus import MAX_RECORD, with_ordinal

#: Code points of a preview, and the page address before the title (fixed values).
PREVIEW, PAGE_URL = 320, "https://simple.wikipedia.org/wiki/"
ACTION = "index struct<_id: string>"
ARTICLE = "page_id long, namespace int, title string, text string, opening_text string"
CATALOG = "external_id string, title string, preview string, source_url string"


def single_line(text: Column) -> Column:
    """White space runs of any kind as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def page_url(title: pd.Series) -> pd.Series:
    """The page's address: spaces as underscores, other signs escaped as in a path."""
    return title.map(lambda t: PAGE_URL + quote(t.replace(" ", "_"), safe="$&+,/:;=@-_.~"), na_action="ignore")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a dump, plain or compressed; the ids of both lines of a pair must be equal."""
    lines = with_ordinal(spark.read.option("lineSep", "\n").text(path)).withColumn("pair", F.shiftright("ordinal", 1))
    action = lines.filter(F.col("ordinal") % 2 == 0).select("pair", F.from_json("value", ACTION).alias("a"))
    article = lines.filter(F.col("ordinal") % 2 == 1).select("pair", F.from_json("value", ARTICLE).alias("r"))
    met = action.join(article, "pair", "full_outer")
    fit = F.coalesce(F.col("a.index._id") == F.col("r.page_id").cast("string"), F.lit(False))
    return met.select("pair", F.when(fit, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("dump entry without its pair: "), F.col("pair").cast("string"))).cast(article.schema["r"].dataType)).alias("r")).select("r.*")


def skip_reason(articles: DataFrame) -> DataFrame:
    """Articles with their one-line title and text and ``reason``: why an article is no record, in this order, or null.

    'namespace' (not 0, or null), 'empty' title or text, 'too_large' (id, tab and text).
    """
    lined = articles.withColumn("title_line", single_line(F.col("title"))).withColumn("text_line", single_line(F.col("text")))
    size = F.octet_length(F.col("page_id").cast("string")) + 1 + F.octet_length("text_line")
    reason = F.when(~F.coalesce(F.col("namespace") == 0, F.lit(False)), "namespace").when((F.col("title_line") == "") | (F.col("text_line") == ""), "empty").when(size > MAX_RECORD, "too_large")
    return lined.withColumn("reason", reason)


def to_corpus(articles: DataFrame) -> DataFrame:
    """(external_id, title, text, preview, source_url) of the articles that are records."""
    kept = skip_reason(articles).filter(F.col("reason").isNull())
    opening = single_line(F.col("opening_text"))
    preview = F.left(F.when(opening != "", opening).otherwise(F.col("text_line")), F.lit(PREVIEW))
    return kept.select(F.col("page_id").cast("string").alias("external_id"), F.col("title_line").alias("title"), F.col("text_line").alias("text"), preview.alias("preview"), page_url("title").alias("source_url"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog of JSON lines, checked: id and title are there, ids differ, addresses are empty or https with a host."""
    catalog = spark.read.schema(CATALOG).json(path)
    bad = catalog_errors(catalog).first()
    if bad is not None:
        raise ValueError(f"catalog: {bad.error} ({bad.external_id})")
    return catalog


def catalog_errors(catalog: DataFrame) -> DataFrame:
    """(external_id, error) of a catalog's rows."""
    url = F.coalesce("source_url", F.lit(""))
    good = (url == "") | ((F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")) == "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""))
    error = F.when(F.coalesce("external_id", F.lit("")) == "", "no id").when(F.coalesce("title", F.lit("")) == "", "no title").when(~good, "address")
    rows = catalog.select("external_id", error.alias("error")).filter(F.col("error").isNotNull())
    twice = catalog.groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("external_id", F.lit("repeated id").alias("error"))
    return rows.unionByName(twice)


def enriched(results: DataFrame, catalog: DataFrame, must: bool = False) -> DataFrame:
    """Results with title, preview and address; ``must`` makes a result without catalog row an error."""
    met = results.join(catalog.select("external_id", "title", "preview", "source_url"), "external_id", "left")
    if not must:
        return met
    return met.withColumn("title", F.when(F.col("title").isNull(), F.raise_error(F.concat(F.lit("no catalog row: "), F.coalesce("external_id", F.lit("null"))))).otherwise(F.col("title")))


def orphans(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results without a catalog row."""
    return results.join(catalog.select("external_id"), "external_id", "left_anti")
