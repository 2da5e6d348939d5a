"""Queries and SQL of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import vertical
from textloom.llm.distinctive import joint_counts, most_distinctive, pmi_weights
from textloom.llm.encode import with_ids, with_sizes
from textloom.llm.lookalike import form_keys, learn_rules, with_forms
from textloom.llm.lshforest import NearDuplicates, near_duplicates
from textloom.llm.mixing import Mixture, mix
from textloom.llm.pairs import HOT_SHARE, across, blocked, group_pairs
from textloom.llm.pii import personal_items, sanitised
from textloom.llm.sql import SQL  # noqa: F401 - read by __spark_entry__
from textloom.llm.topn import top_n
from textloom.operators.skew import lookup_join
from textloom.session import spread, table, written

RARE_BELOW, COMMON_ABOVE = 3, 0.2


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "dump_article").select("page_id", "title", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles whose titles or texts look the same but are different strings."""
    articles = _articles(spark, sf_dir)
    keys = written(form_keys(articles, "page_id", ["title", "text"], learn_rules(articles, ["title", "text"])), "forms").distinct()
    # Strings with their forms, each once, whatever number of articles holds them; then forms that stand for several strings.
    strings = written(keys.groupBy("field", "form_key", "string_key").agg(F.count(F.lit(1)).alias("n")).drop("n"), "strings")
    several = strings.groupBy("field", "form_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    apart = group_pairs(strings.join(several, ["field", "form_key"], "left_semi").withColumn("g", F.struct("field", "form_key")), "g", "string_key")
    links = written(apart.select(F.struct("g.field", F.col("a").alias("s")).alias("a"), F.struct("g.field", F.col("b").alias("s")).alias("b")), "links")
    # Articles are held against the strings of the links; a string of many articles lies in blocks.
    asked = links.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    held = keys.select(F.struct("field", F.col("string_key").alias("s")).alias("g"), F.col("page_id").alias("x")).join(asked, "g", "left_semi")
    met = across(links.withColumn("field", F.col("a.field")), written(blocked(held, "g", "x"), "blocks")).filter("a <> b")
    return met.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"), "field").distinct()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article and field: its class of strings that look the same, and with how many other strings of it."""
    articles = _articles(spark, sf_dir)
    keys = written(form_keys(articles, "page_id", ["title", "text"], learn_rules(articles, ["title", "text"])), "forms").distinct()
    sizes = keys.groupBy("field", "form_key", "string_key").agg(F.count(F.lit(1)).alias("c")).groupBy("field", "form_key").agg((F.count(F.lit(1)) - 1).alias("links"), F.sum("c").alias("n")).withColumn("k", F.struct("field", "form_key"))
    told = lookup_join(keys.withColumn("k", F.struct("field", "form_key")), sizes.select("k", "links", "n"), "k", F.col("n") > F.lit(HOT_SHARE * max(1, keys.count())))
    return told.select("page_id", "field", F.hex("form_key").alias("class"), "links").distinct()


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of every article in their consistent form."""
    articles = _articles(spark, sf_dir)
    return with_forms(articles, ["title", "text"], learn_rules(articles, ["title", "text"]), ["page_id"]).distinct()


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    articles = _articles(spark, sf_dir)
    rules = learn_rules(articles, ["title", "text"])
    return near_duplicates(articles, "page_id", ["title", "text"], rules, size=3, threshold=0.5, min_words=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles of at least 20 words with at least half of their sets of three words in common."""
    return _near(spark, sf_dir).pairs().select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article of at least 20 words: its group of near-duplicates and its number of links."""
    return _near(spark, sf_dir).groups().withColumnRenamed("key", "page_id")


def _article_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vertical.of_texts(spread(table(spark, sf_dir, "dump_article").select("page_id", "text")), "page_id", "text")
    freq = written(vertical.frequencies(found), "frequencies")
    n = freq.filter(F.col("term") == vertical.ANY).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"))
    return vertical.marked(freq, "records", n, RARE_BELOW, COMMON_ABOVE)


def _record_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "term_record").select("term", F.col("run_id").alias("key"), F.col("df").alias("count"))
    with_term = table(spark, sf_dir, "corpus_record").filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select(F.lit(vertical.ANY).alias("term"), F.col("ordinal").alias("key"), F.lit(1).cast("long").alias("count"))
    found = vertical.of_counts(rows.filter(F.col("term") != vertical.ANY).unionByName(with_term), "term", "key", "count")
    freq = written(vertical.frequencies(found), "frequencies")
    n = freq.filter(F.col("term") == vertical.ANY).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"))
    return vertical.marked(freq, "occurrences", n, RARE_BELOW, COMMON_ABOVE)


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records (articles, or runs of the dictionary) of every term, with the mark."""
    a, r = _article_terms(spark, sf_dir), _record_terms(spark, sf_dir)
    columns = ["term", "occurrences", "records", "mark"]
    return a.select(F.lit("article").alias("scope"), *columns).unionByName(r.select(F.lit("record").alias("scope"), *columns))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to be marked."""
    return p2_terms(spark, sf_dir).filter(F.col("mark").isNotNull()).select("scope", "term")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best results of each query."""
    return p5_ranked(spark, sf_dir).select("query_id", "doc_id")


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with place, external id and score."""
    return top_n(table(spark, sf_dir, "search_result").select("query_id", "doc_id", "external_id", "score"), 10).select("query_id", "place", "doc_id", "external_id", "score")


def _record_weights(spark: SparkSession, sf_dir: str, alpha: float, positive: bool, by_tf: bool) -> DataFrame:
    joint = written(joint_counts(spread(table(spark, sf_dir, "corpus_record").select("ordinal", "text"))), "joint")
    n = joint.select("_key").distinct().count()
    rows = table(spark, sf_dir, "term_record").select("run_id", "term", "df").dropDuplicates(["run_id", "term"])
    return pmi_weights(joint, rows.groupBy("term").agg(F.sum("df").alias("df")), n, alpha, positive, by_tf)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of each record with the highest tf * ln(N / df): the operator with exponent 0, weighed by tf."""
    return most_distinctive(_record_weights(spark, sf_dir, 0, False, True)).select(F.col("_key").alias("ordinal"), "term")


def p7_ppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pointwise mutual information of every term and record, contexts smoothed by the exponent 0.75."""
    return _record_weights(spark, sf_dir, 0.75, True, False).select(F.col("_key").alias("ordinal"), "term", "tf", "df", F.round("weight", 6).alias("ppmi"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return with_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter(F.col("source").isNotNull()))
    return mix(with_sizes(documents, keep=("doc_id", "source")), table(spark, sf_dir, "mix_target"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, sf_dir).copies.select("doc_id", "source", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixture(spark, sf_dir).report


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "name_list"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different personal item of a document, as it stands in the text."""
    return _items(spark, sf_dir).select("doc_id", "kind", "found").distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of its personal items."""
    return sanitised(table(spark, sf_dir, "documents").select("doc_id", "text"), _items(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p5_ranked": p5_ranked,
    "p7_found": p7_found,
    "p7_ppmi": p7_ppmi,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_clean": p10_clean,
}
