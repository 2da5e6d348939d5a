"""Queries of the ranking engine over the driver's tables, and the SQL that checks them.

Corpora: ``documents`` and ``corpus_record``, whole. Query sets: the titles of the articles,
and the texts of the records, whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import bm25
from textloom.functions.analysis import STOP_WORDS, terms
from textloom.functions.text import SQL_TERM
from textloom.operators import blocks, evaluate, search
from textloom.operators.index import Index, build, build_report, kept, merge, open_index, write
from textloom.operators.verify import block_violations, verify, violations
from textloom.plans.general import RAW_LINES
from textloom.session import shared_dir, shuffles_dropped, spread, table
from textloom.sources import corpus, wiki
from textloom.sources.observations import read_qrels
from textloom.streaming.segments import append_segments, open_segments

QUERY_STEP = 50
ONE_QUERY = "the tidal cathedral of the northern weavers, a tidal cathedral"
TIE_QUERY = "station bridge river archive"
LOOKUP = ("cathedral", "peninsula", "quarry", "wordthatisnotthere")
_KEPT: dict[tuple[str, str, str, str], Index] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "external_id", "text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "corpus_record").select(F.col("ordinal").alias("doc_id"), "external_id", "text"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("text")))


def indexed(spark: SparkSession, sf_dir: str, name: str = "documents", profile: str = "plain") -> Index:
    """The index of a corpus, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, profile)
    if key not in _KEPT:
        with shuffles_dropped(spark):
            _KEPT[key] = kept(build({"documents": documents, "records": records, "parts": parts}[name](spark, sf_dir), profile))
    return _KEPT[key]


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "dump_article").select(F.col("page_id").alias("query_id"), F.col("title").alias("text")).filter(F.col("query_id") % QUERY_STEP == 0).distinct())


def record_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "text").filter(F.col("query_id") % QUERY_STEP == 0)


def _shown(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.round("score", 6))


# --- analysis and index ------------------------------------------------------------


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(documents(spark, sf_dir)).documents.select("doc_id", "length")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).stats.withColumn("average_length", F.round("average_length", 9))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(documents(spark, sf_dir)).postings.select("term", "doc_id", "tf")


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).terms


def english_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir, profile="english").terms


def build_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_report(indexed(spark, sf_dir))


def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of four segments, built one by one and merged."""
    rows = documents(spark, sf_dir)
    return merge([build(rows.filter(F.pmod("doc_id", F.lit(4)) == i)) for i in range(4)]).terms


def streamed_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of segments that a stream over the table wrote."""
    import uuid

    path = f"{shared_dir(spark)}/textloom-stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "documents")
    # A stream reads a folder of files; a table of one file is found by its name in its folder.
    where = f"{sf_dir.rstrip('/')}/documents.parquet"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    folder = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm).isDirectory()
    reader = spark.readStream.schema(source.schema)
    stream = reader.parquet(where) if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    append_segments(stream.select("doc_id", "external_id", "text"), path, f"{path}/checkpoint").awaitTermination()
    return open_segments(spark, path).terms


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).postings.filter(F.col("term").isin(*LOOKUP)).select("term", "doc_id", "tf")


# --- ranking -----------------------------------------------------------------------


def prepared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prepared(record_queries(spark, sf_dir))


def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = search.query_plan(indexed(spark, sf_dir), prepared_queries(spark, sf_dir))
    return plan.select("query_id", "term", "df", F.round("idf", 9).alias("idf"), F.round("bound", 9).alias("bound"))


def bm25_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    plan = search.query_plan(index, prepared_queries(spark, sf_dir))
    return search.contributions(index, plan).withColumn("c", F.round("c", 9))


def search_single_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search_one(indexed(spark, sf_dir), ONE_QUERY, 10, digits=9))


def search_batch_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(indexed(spark, sf_dir), record_queries(spark, sf_dir), 10, digits=9))


def search_titles_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(indexed(spark, sf_dir), title_queries(spark, sf_dir), 10, digits=9))


def search_batch_top1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(indexed(spark, sf_dir), record_queries(spark, sf_dir), 1000, digits=9))


def search_pruned_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(indexed(spark, sf_dir), record_queries(spark, sf_dir), 10, "pruned", digits=9))


def search_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search_one(indexed(spark, sf_dir, "records"), TIE_QUERY, 100, digits=9))


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(indexed(spark, sf_dir, "records"), record_queries(spark, sf_dir), 10, digits=9))


def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    asked = rows.filter(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"), "text")
    return _shown(search.search(indexed(spark, sf_dir, "parts"), asked, 10, digits=9))


def english_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(indexed(spark, sf_dir, profile="english"), record_queries(spark, sf_dir), 10, digits=9))


def result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.digests(search.search(indexed(spark, sf_dir), record_queries(spark, sf_dir), 10))


def daat_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exhaustive_work(indexed(spark, sf_dir), record_queries(spark, sf_dir))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.union_work(indexed(spark, sf_dir), record_queries(spark, sf_dir))


def work_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pruning_work(indexed(spark, sf_dir), record_queries(spark, sf_dir))


def pivot_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pivot_work(indexed(spark, sf_dir), record_queries(spark, sf_dir))


# --- blocks, codecs, cursors, verification -------------------------------------------


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.posting_blocks(indexed(spark, sf_dir).postings).select("term", "block_no", F.col("n").cast("long").alias("n"), "last_doc_id")


def block_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_sizes(indexed(spark, sf_dir).postings).select("term", "block_no", "raw_bytes", "vbyte_bytes")


def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return blocks.file_sizes(index.documents, index.terms, blocks.block_sizes(index.postings))


def _targets(index: Index) -> DataFrame:
    return index.terms.select("term").crossJoin(F.broadcast(index.documents.agg(F.max("doc_id").alias("m")))).select("term", F.explode(F.array(F.lit(1).cast("long"), F.floor(F.col("m") / 2).cast("long"), F.col("m"))).alias("target"))


def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    return blocks.advance(index.postings, _targets(index))


def cursor_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.next_postings(indexed(spark, sf_dir).postings)


def _roundtrip(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return blocks.decoded(blocks.posting_blocks(indexed(spark, sf_dir).postings, codec), codec)

    return run


def run_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_bytes(indexed(spark, sf_dir), 100)


def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.segment_report(indexed(spark, sf_dir), 100, 4)


def observed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of all queries summed per executor, from observations written as JSON lines and read back."""
    import uuid

    from textloom.sources.observations import read_observations, write_observations

    index, asked = indexed(spark, sf_dir), record_queries(spark, sf_dir)
    path = f"{shared_dir(spark)}/textloom-observations-{uuid.uuid4().hex}"
    work = search.exhaustive_work(index, asked).select(F.lit(1).alias("repetition"), F.lit("vbyte").alias("codec"), F.lit("exhaustive").alias("executor"), F.lit(10).alias("k"), F.col("query_id").cast("string").alias("query_id"), F.lit("ok").alias("status"), F.least(F.lit(10), F.col("candidates")).cast("int").alias("results"), F.lit(0).cast("long").alias("nanoseconds"), "query_terms", "matched_terms", "postings_decoded", "blocks_decoded", F.col("bytes").alias("bytes_requested"), F.col("candidates").alias("candidates_scored"))
    write_observations(work, path)
    counters = ("query_terms", "matched_terms", "postings_decoded", "blocks_decoded", "bytes_requested", "candidates_scored")
    return evaluate.observation_summary(read_observations(spark, path), counters=counters).select("executor", "k", "queries", "failures", "short_results", *counters)


def verify_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the index as it is in memory."""
    index = indexed(spark, sf_dir)
    return violations(index).unionByName(block_violations(index, blocks.posting_blocks(index.postings, "raw"), "raw"))


def verify_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the index written, opened and read again."""
    import uuid

    path = f"{shared_dir(spark)}/textloom-index-{uuid.uuid4().hex}"
    write(indexed(spark, sf_dir), path)
    return verify(spark, path)


def reopened_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary read from a written index."""
    import uuid

    path = f"{shared_dir(spark)}/textloom-index-{uuid.uuid4().hex}"
    write(indexed(spark, sf_dir), path, "raw")
    return open_index(spark, path).terms


# --- sources and sinks ---------------------------------------------------------------


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSV lines by the reason why they are no record, or null; in the JVM alone."""
    lines = table(spark, sf_dir, "raw_record").filter("fmt = 'tsv'").select("line_no", F.col("line").cast("string").alias("value"))
    return corpus.parsed(lines).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as TSV and read back with their ordinals."""
    import uuid

    path = f"{shared_dir(spark)}/textloom-tsv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "corpus_record").select("ordinal", "external_id", "text")
    corpus.write_tsv(rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal"), path)
    return corpus.read_tsv(spark, path)


def wiki_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "dump_article").select("page_id", "namespace", "title", "text", "opening_text").distinct()
    return wiki.to_corpus(articles)


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "dump_article").select("page_id", "namespace", "title", "text").distinct()
    return wiki.skip_reason(articles).groupBy("reason").agg(F.count(F.lit(1)).alias("articles"))


def single_line_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.left(wiki.single_line(F.col("text")), F.lit(wiki.PREVIEW)).alias("preview"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "corpus_record").select(F.col("ordinal").alias("doc_id"), "text")
    return rows.select("doc_id", wiki.single_line(F.col("text")).alias("title")).filter("title <> ''").select(F.col("doc_id").cast("string").alias("external_id"), F.left("title", F.lit(40)).alias("title"), "title", F.lit("").alias("source_url")).toDF("external_id", "title", "preview", "source_url")


def _catalog_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_result").select("query_id", F.col("doc_id").cast("string").alias("external_id")).distinct()


def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.enriched(_catalog_results(spark, sf_dir), _catalog(spark, sf_dir)).select("query_id", "external_id", "title", "preview")


def catalog_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.orphans(_catalog_results(spark, sf_dir), _catalog(spark, sf_dir))


def catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog made of the articles as they were delivered, with addresses of three sorts, and what is wrong with its rows."""
    url = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://wiki.example/"), F.col("page_id").cast("string"))).otherwise("http://wiki.example/")
    rows = table(spark, sf_dir, "dump_article").select(F.col("page_id").cast("string").alias("external_id"), "title", url.alias("source_url"))
    return wiki.catalog_errors(rows)


# --- evaluation -----------------------------------------------------------------------


def _known_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    run = search.search(indexed(spark, sf_dir, "records"), record_queries(spark, sf_dir), 100, digits=9)
    qrels = record_queries(spark, sf_dir).select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("rel"))
    return run, qrels


def mrr_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reciprocal_rank(*_known_items(spark, sf_dir), 10).withColumn("mrr", F.round("mrr", 9))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(*_known_items(spark, sf_dir), (1, 10, 100)).withColumn("recall", F.round("recall", 9))


def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.trec_run(search_batch_top10(spark, sf_dir), "textloom")


def qrels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of the known items written as lines and read back."""
    import uuid

    path = f"{shared_dir(spark)}/textloom-qrels-{uuid.uuid4().hex}"
    rows = record_queries(spark, sf_dir).select(F.concat_ws("\t", F.col("query_id").cast("string"), F.lit("0"), F.col("query_id").cast("string"), F.lit("1")))
    rows.write.text(path)
    return read_qrels(spark, path)


def build_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a build that is taken to last two seconds, from the true numbers of documents, terms, postings and bytes."""
    index = indexed(spark, sf_dir)
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("input_bytes"))
    taken = blocks.file_sizes(index.documents, index.terms, blocks.block_sizes(index.postings)).filter("codec = 'vbyte'").agg(F.sum("bytes").alias("index_bytes"))
    facts = build_report(index).select("documents", "tokens", "postings", F.lit(2.0).alias("seconds"))
    rates = evaluate.build_rates(facts.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(taken)))
    return rates.select("documents_per_second", "tokens_per_second", "postings_per_second", F.round("input_mib_per_second", 9).alias("input_mib_per_second"), F.round("bytes_per_posting", 9).alias("bytes_per_posting"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value")


QUERIES = {
    "tokenize": tokenize,
    "doc_lengths": doc_lengths,
    "corpus_stats": corpus_stats,
    "postings": postings,
    "term_dictionary": term_dictionary,
    "english_dictionary": english_dictionary,
    "build_report": build_facts,
    "segment_merge": segment_merge,
    "streamed_dictionary": streamed_dictionary,
    "term_lookup": term_lookup,
    "prepared_queries": prepared_queries,
    "query_plan": query_plan,
    "bm25_contributions": bm25_contributions,
    "search_single_top10": search_single_top10,
    "search_batch_top10": search_batch_top10,
    "search_titles_top10": search_titles_top10,
    "search_batch_top1000": search_batch_top1000,
    "search_pruned_top10": search_pruned_top10,
    "search_ties": search_ties,
    "search_records": search_records,
    "search_parts": search_parts,
    "english_search_top10": english_search_top10,
    "result_digest": result_digest,
    "daat_work": daat_work,
    "candidate_union": candidate_union,
    "work_reduction": work_reduction,
    "pivot_counters": pivot_counters,
    "posting_blocks": posting_blocks,
    "block_bytes": block_bytes,
    "index_sizes": index_sizes,
    "cursor_advance": cursor_advance,
    "cursor_next": cursor_next,
    "raw_roundtrip": _roundtrip("raw"),
    "vbyte_roundtrip": _roundtrip("vbyte"),
    "run_bytes": run_sizes,
    "segment_report": segment_report,
    "observed_work": observed_work,
    "verify_clean": verify_clean,
    "verify_written": verify_written,
    "reopened_dictionary": reopened_dictionary,
    "validate_records": validate_records,
    "tsv_roundtrip": tsv_roundtrip,
    "wiki_corpus": wiki_corpus,
    "skip_reasons": skip_reasons,
    "single_line_preview": single_line_preview,
    "catalog_join": catalog_join,
    "catalog_orphans": catalog_orphans,
    "catalog_errors": catalog_errors,
    "qrels_roundtrip": qrels_roundtrip,
    "build_rates": build_rates,
    "mrr_at_10": mrr_at_10,
    "recall_at_k": recall_at_k,
    "trec_run": trec_run,
    "latency_percentiles": latency_percentiles,
}

# --- SQL ------------------------------------------------------------------------------

_STOP = ", ".join("'" + w + "'" for w in STOP_WORDS)


def _fold(text: str) -> str:
    out = f"lower(nfc_normalize({text}))"
    for a, b in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _cut(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({_fold(f'coalesce({text}, chr(32))')}, '{SQL_TERM}'), lambda t: replace(t, '’', '''')), lambda t: t NOT IN ({_STOP}))"


def _index(source: str, key: str, external: str, text: str) -> str:
    return f"""WITH src AS (SELECT {key} AS doc_id, {external} AS external_id, {_cut(text)} AS ts FROM {source}),
 p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM src) GROUP BY ALL),
 dl AS (SELECT doc_id, external_id, CAST(len(ts) AS BIGINT) AS length FROM src),
 st AS (SELECT count(*) AS documents, count(*) FILTER (length > 0) AS n, CAST(coalesce(sum(length), 0) AS BIGINT) AS total, coalesce(sum(length) / count(*) FILTER (length > 0), 0) AS a FROM dl),
 dict AS (SELECT term, count(*) AS df, max(tf) AS max_tf, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term)"""


_DOCS = _index("documents", "doc_id", "external_id", "text")
_RECS = _index("corpus_record", "ordinal", "external_id", "text")
_PARTS = _index("part", "p_partkey", "CAST(p_partkey AS VARCHAR)", "p_name")
_TITLES = f", q AS (SELECT DISTINCT query_id, unnest({_cut('t')}) AS term FROM (SELECT DISTINCT page_id AS query_id, title AS t FROM dump_article WHERE page_id % {QUERY_STEP} = 0))"
_ASKED = f", q AS (SELECT DISTINCT query_id, unnest({_cut('t')}) AS term FROM (SELECT ordinal AS query_id, text AS t FROM corpus_record WHERE ordinal % {QUERY_STEP} = 0))"
_OWN = f", q AS (SELECT DISTINCT doc_id AS query_id, unnest(ts) AS term FROM src WHERE doc_id % {QUERY_STEP} = 0)"
_IDF = "ln(1 + ((n - df) + 0.5) / (df + 0.5))"
_K, _L = bm25.K1, bm25.B


def _frac(tf: str, length: str) -> str:
    return f"({tf} * {_K + 1}) / ({tf} + {_K} * ({1 - _L} + {_L} * ({length} / a)))"


_PLAN = f", plan AS (SELECT query_id, term, df, max_tf, {_IDF} AS idf, {_IDF} * ({_frac('max_tf', 'max_tf')}) AS bound FROM q JOIN dict USING (term), st)"
_PART = f", c AS (SELECT query_id, term, doc_id, idf * ({_frac('tf', 'length')}) AS c FROM plan JOIN p USING (term) JOIN dl USING (doc_id), st)"
_SCORE = ", s AS (SELECT query_id, doc_id, sum(c ORDER BY term) AS score FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"
_RANK = _PLAN + _PART + _SCORE
_OUT = "SELECT query_id, rank, doc_id, external_id, round(score, 6) AS score FROM r JOIN dl USING (doc_id) WHERE rank <= "


def _one(text: str) -> str:
    return f", q AS (SELECT DISTINCT 0 AS query_id, unnest({_cut(chr(39) + text + chr(39))}) AS term)"


_OUT_ONE = "SELECT rank, doc_id, external_id, round(score, 6) AS score FROM r JOIN dl USING (doc_id) WHERE rank <= "
_BLOCKS = ", n0 AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS k FROM p), nb AS (SELECT *, CAST(floor(k / 128) AS BIGINT) AS block_no FROM n0)"


def _size(v: str) -> str:
    return f"CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 WHEN {v} < 2097152 THEN 3 WHEN {v} < 268435456 THEN 4 ELSE 5 END"


_SIZES = _BLOCKS + f", g AS (SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, block_no ORDER BY doc_id), 0) AS gap FROM nb), bs AS (SELECT term, block_no, count(*) AS n, max(doc_id) AS last_doc_id, CAST(count(*) * 8 AS BIGINT) AS raw_bytes, CAST(sum({_size('gap')} + {_size('tf')}) AS BIGINT) AS vbyte_bytes FROM g GROUP BY ALL)"
_WORK = _SIZES + f"""{_ASKED}, tb AS (SELECT term, sum(vbyte_bytes + 8) AS bytes FROM bs GROUP BY term),
 m AS (SELECT query_id, count(*) AS matched_terms, sum(df) AS postings_decoded, sum(ceil(df / 128)) AS blocks_decoded, sum(bytes) AS bytes FROM q JOIN dict USING (term) JOIN tb USING (term) GROUP BY query_id),
 u AS (SELECT query_id, count(DISTINCT doc_id) AS candidates FROM q JOIN p USING (term) GROUP BY query_id),
 w AS (SELECT query_id, count(*) AS query_terms FROM q GROUP BY query_id)
 SELECT query_id, query_terms, CAST(coalesce(matched_terms, 0) AS BIGINT) AS matched_terms, CAST(coalesce(postings_decoded, 0) AS BIGINT) AS postings_decoded, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates, CAST(coalesce(blocks_decoded, 0) AS BIGINT) AS blocks_decoded, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM w LEFT JOIN m USING (query_id) LEFT JOIN u USING (query_id)"""
_DICT = _DOCS + " SELECT term, df, max_tf, cf FROM dict"
_LINE = r"trim(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}\x85]+', ' ', 'g'), ' ')"


def _line(text: str) -> str:
    return _LINE.format(text)


_CHECKS = "document_ids_distinct document_ids_in_range external_ids lengths terms_distinct terms term_counts_in_range dictionary_of_postings term_counts shards postings_distinct postings_frequencies postings_shards postings_documents document_totals blocks_decode blocks_in_order blocks_hold_postings".split()
_FILE_CHECKS = [f"checksum_{t}" for t in ("documents", "postings", "terms", "shards", "blocks")]


def _zero(names: list[str]) -> str:
    return "SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS \"check\", CAST(0 AS BIGINT) AS violations"


_KNOWN = f"{_RECS}{_OWN}{_RANK}, qr AS (SELECT ordinal AS query_id, ordinal AS doc_id FROM corpus_record WHERE ordinal % {QUERY_STEP} = 0)"
_CATALOG = f"WITH cat AS (SELECT CAST(ordinal AS VARCHAR) AS external_id, left({_line('text')}, 40) AS title, {_line('text')} AS preview FROM corpus_record WHERE {_line('text')} <> ''), res AS (SELECT DISTINCT query_id, CAST(doc_id AS VARCHAR) AS external_id FROM search_result)"
_WIKI = f"WITH w AS (SELECT DISTINCT page_id, namespace, title, text, {_line('title')} AS tl, {_line('text')} AS xl FROM dump_article), z AS (SELECT *, CASE WHEN namespace IS NULL OR namespace <> 0 THEN 'namespace' WHEN tl = '' OR xl = '' THEN 'empty' WHEN strlen(CAST(page_id AS VARCHAR)) + 1 + strlen(xl) > 1048576 THEN 'too_large' END AS reason FROM w)"

_URL = "url_encode(replace(title, ' ', '_'))"
for _code, _sign in (("24", "$"), ("26", "&"), ("2B", "+"), ("2C", ","), ("2F", "/"), ("3A", ":"), ("3B", ";"), ("3D", "="), ("40", "@")):
    _URL = f"replace({_URL}, '%{_code}', '{_sign}')"

SQL = {
    "wiki_corpus": _WIKI.replace("page_id, namespace, title, text,", "page_id, namespace, title, text, opening_text,") + f" SELECT CAST(page_id AS VARCHAR) AS external_id, tl AS title, xl AS text, left(CASE WHEN {_line('opening_text')} <> '' THEN {_line('opening_text')} ELSE xl END, {wiki.PREVIEW}) AS preview, '{wiki.PAGE_URL}' || {_URL} AS source_url FROM z WHERE reason IS NULL",
    "validate_records": f"""WITH {RAW_LINES} SELECT CASE WHEN len(h) > 2 * 1048576 THEN 'too_large' WHEN s IS NULL THEN 'invalid_utf8' WHEN instr(s, chr(9)) = 0 THEN 'column_count' WHEN instr(s, chr(9)) = 1 THEN 'empty_id'
  WHEN strlen(split_part(s, chr(9), 1)) > 1024 THEN 'id_too_large' END AS reason, count(*) AS lines FROM raw WHERE fmt = 'tsv' GROUP BY ALL""",
    "tokenize": _DOCS + " SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, term FROM (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM src)",
    "doc_lengths": _DOCS + " SELECT doc_id, length FROM dl",
    "corpus_stats": _DOCS + " SELECT documents, n AS documents_with_terms, total AS total_length, round(a, 9) AS average_length FROM st",
    "postings": _DOCS + " SELECT term, doc_id, tf FROM p",
    "term_dictionary": _DICT,
    "build_report": _DOCS + " SELECT documents, n AS documents_with_terms, total AS tokens, (SELECT count(*) FROM p) AS postings FROM st",
    "segment_merge": _DICT,
    "streamed_dictionary": _DICT,
    "reopened_dictionary": _DICT,
    "term_lookup": _DOCS + " SELECT term, doc_id, tf FROM p WHERE term IN (" + ", ".join(f"'{t}'" for t in LOOKUP) + ")",
    "prepared_queries": _DOCS + _ASKED + " SELECT query_id, term FROM q",
    "query_plan": _DOCS + _ASKED + _PLAN + " SELECT query_id, term, df, round(idf, 9) AS idf, round(bound, 9) AS bound FROM plan",
    "bm25_contributions": _DOCS + _ASKED + _PLAN + _PART + " SELECT query_id, term, doc_id, round(c, 9) AS c FROM c",
    "search_single_top10": _DOCS + _one(ONE_QUERY) + _RANK + _OUT_ONE + "10",
    "search_batch_top10": _DOCS + _ASKED + _RANK + _OUT + "10",
    "search_titles_top10": _DOCS + _TITLES + _RANK + _OUT + "10",
    "search_batch_top1000": _DOCS + _ASKED + _RANK + _OUT + "1000",
    "search_pruned_top10": _DOCS + _ASKED + _RANK + _OUT + "10",
    "search_ties": _RECS + _one(TIE_QUERY) + _RANK + _OUT_ONE + "100",
    "search_records": _RECS + _OWN + _RANK + _OUT + "10",
    "search_parts": _PARTS + _OWN + _RANK + _OUT + "10",
    "daat_work": _DOCS + _WORK,
    "work_reduction": _DOCS + _ASKED + _PLAN + _PART + """, f AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS i FROM plan) WHERE i = 1),
 lo AS (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS k FROM c JOIN f USING (query_id, term)), th AS (SELECT query_id, c AS theta FROM lo WHERE k = 10),
 g AS (SELECT query_id, doc_id, sum(bound) AS b FROM c JOIN plan USING (query_id, term) GROUP BY ALL)
 SELECT query_id, count(*) AS exhaustive, count(*) FILTER (theta IS NULL OR b >= theta * (1 - 1e-12)) AS pruned FROM g LEFT JOIN th USING (query_id) GROUP BY query_id""",
    "candidate_union": f"SELECT query_id, candidates, postings_decoded AS postings FROM ({_DOCS}{_WORK})",
    "posting_blocks": _DOCS + _BLOCKS + " SELECT term, block_no, count(*) AS n, max(doc_id) AS last_doc_id FROM nb GROUP BY ALL",
    "block_bytes": _DOCS + _SIZES + " SELECT term, block_no, raw_bytes, vbyte_bytes FROM bs",
    "index_sizes": _DOCS + _SIZES + """, x AS (SELECT (SELECT count(*) FROM dl) AS d, (SELECT coalesce(sum(strlen(external_id)), 0) FROM dl) AS ids, (SELECT coalesce(sum(24 + strlen(term)), 0) FROM dict) AS t, (SELECT coalesce(sum(raw_bytes + 8), 0) FROM bs) AS raw, (SELECT coalesce(sum(vbyte_bytes + 8), 0) FROM bs) AS vb),
 k AS (SELECT unnest(['raw', 'vbyte']) AS codec), f AS (SELECT unnest(['metadata', 'terms', 'postings', 'lengths', 'offsets', 'identifiers']) AS file)
 SELECT file, codec, CAST(CASE file WHEN 'metadata' THEN 80 WHEN 'terms' THEN 12 + t WHEN 'postings' THEN 12 + CASE codec WHEN 'raw' THEN raw ELSE vb END WHEN 'lengths' THEN 12 + 4 * d WHEN 'offsets' THEN 12 + 8 * (d + 1) ELSE 12 + ids END AS BIGINT) AS bytes FROM f, k, x""",
    "cursor_advance": _DOCS + _BLOCKS + """, m AS (SELECT max(doc_id) AS m FROM dl), t AS (SELECT term, unnest([1, CAST(floor(m / 2) AS BIGINT), m]) AS target FROM dict, m),
 b AS (SELECT term, block_no, max(doc_id) AS last FROM nb GROUP BY ALL),
 k AS (SELECT t.term, target, count(*) FILTER (block_no >= 1 AND last < target) AS blocks_skipped FROM t JOIN b USING (term) GROUP BY ALL),
 h AS (SELECT t.term, target, min(p.doc_id) AS doc_id, arg_min(p.tf, p.doc_id) AS tf FROM t JOIN p ON p.term = t.term AND p.doc_id >= target GROUP BY ALL)
 SELECT DISTINCT k.term, k.target, doc_id, tf, blocks_skipped FROM k LEFT JOIN h ON h.term = k.term AND h.target = k.target""",
    "cursor_next": _DOCS + " SELECT term, doc_id, lead(doc_id) OVER (PARTITION BY term ORDER BY doc_id) AS next_doc_id FROM p",
    "raw_roundtrip": _DOCS + " SELECT term, doc_id, tf FROM p",
    "vbyte_roundtrip": _DOCS + " SELECT term, doc_id, tf FROM p",
    "run_bytes": _DOCS + ", sg AS (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS segment, term, count(*) AS n FROM p GROUP BY ALL), ss AS (SELECT segment, sum(12 + strlen(term) + 8 * n) AS b FROM sg GROUP BY segment) SELECT segment, CAST(24 + coalesce(b, 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT CAST(floor(doc_id / 100) AS BIGINT) AS segment FROM dl) LEFT JOIN ss USING (segment)",
    "observed_work": "SELECT 'exhaustive' AS executor, 10 AS k, count(*) AS queries, 0 AS failures, count(*) FILTER (candidates < 10) AS short_results, CAST(sum(query_terms) AS BIGINT) AS query_terms, CAST(sum(matched_terms) AS BIGINT) AS matched_terms, CAST(sum(postings_decoded) AS BIGINT) AS postings_decoded, CAST(sum(blocks_decoded) AS BIGINT) AS blocks_decoded, CAST(sum(bytes) AS BIGINT) AS bytes_requested, CAST(sum(candidates) AS BIGINT) AS candidates_scored FROM (" + _DOCS + _WORK + ")",
    "segment_report": _DOCS + """, lv AS (SELECT CAST(floor(doc_id / w) AS BIGINT) AS s, w, term, count(*) AS n FROM p, (SELECT unnest([100, 400, 1600, 6400, 25600, 102400, 409600, 1638400, 6553600]) AS w) GROUP BY ALL),
 sb AS (SELECT w, s, 24 + coalesce(b, 0) AS bytes FROM (SELECT DISTINCT w, CAST(floor(doc_id / w) AS BIGINT) AS s FROM dl, (SELECT DISTINCT w FROM lv)) LEFT JOIN (SELECT w, s, sum(12 + strlen(term) + 8 * n) AS b FROM lv GROUP BY ALL) USING (w, s)),
 nr AS (SELECT w, count(*) AS runs FROM sb GROUP BY w),
 gr AS (SELECT w, CAST(floor(s / 4) AS BIGINT) AS g, count(*) AS n, sum(bytes) AS b FROM sb GROUP BY ALL),
 mg AS (SELECT gr.w, sum(gr.b) AS i, sum(sb.bytes) AS o FROM gr JOIN sb ON sb.w = gr.w * 4 AND sb.s = gr.g WHERE gr.n > 1 GROUP BY gr.w)
 SELECT documents, n AS documents_with_terms, total AS tokens, (SELECT count(*) FROM p) AS postings, (SELECT runs FROM nr WHERE w = 100) AS runs, (SELECT count(*) FROM nr WHERE runs > 1) AS merge_passes, CAST((SELECT coalesce(sum(i), 0) FROM mg) AS BIGINT) AS merge_input_bytes, CAST((SELECT coalesce(sum(o), 0) FROM mg) AS BIGINT) AS merge_output_bytes FROM st""",
    "verify_clean": _zero(_CHECKS),
    "verify_written": _zero(_FILE_CHECKS + _CHECKS),
    "tsv_roundtrip": "SELECT ordinal, external_id, coalesce(text, '') AS text FROM corpus_record",
    "skip_reasons": _WIKI + " SELECT reason, count(*) AS articles FROM z GROUP BY reason",
    "single_line_preview": f"SELECT doc_id, left({_line('text')}, 320) AS preview FROM documents",
    "catalog_join": _CATALOG + " SELECT query_id, external_id, title, preview FROM res LEFT JOIN cat USING (external_id)",
    "catalog_orphans": _CATALOG + " SELECT query_id, external_id FROM res WHERE external_id NOT IN (SELECT external_id FROM cat)",
    "mrr_at_10": _KNOWN + " SELECT count(*) AS queries, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM qr LEFT JOIN (SELECT * FROM r WHERE rank <= 10) USING (query_id, doc_id)",
    "recall_at_k": _KNOWN + ", k AS (SELECT unnest([1, 10, 100]) AS k) SELECT k, count(*) AS queries, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END), 9) AS recall FROM qr LEFT JOIN (SELECT * FROM r WHERE rank <= 100) USING (query_id, doc_id), k GROUP BY k",
    "trec_run": _DOCS + _ASKED + _RANK + "SELECT query_id || ' Q0 ' || doc_id || ' ' || rank || ' ' || (-rank) || ' textloom' AS line FROM r WHERE rank <= 10",
    "catalog_errors": "WITH c AS (SELECT CAST(page_id AS VARCHAR) AS external_id, title, page_id % 3 = 2 AS bad FROM dump_article) SELECT external_id, CASE WHEN coalesce(external_id, '') = '' THEN 'no id' WHEN coalesce(title, '') = '' THEN 'no title' ELSE 'address' END AS error FROM c WHERE coalesce(external_id, '') = '' OR coalesce(title, '') = '' OR bad UNION ALL SELECT external_id, 'repeated id' FROM c GROUP BY external_id HAVING count(*) > 1",
    "qrels_roundtrip": f"SELECT CAST(ordinal AS VARCHAR) AS query_id, CAST(ordinal AS VARCHAR) AS doc_id, 1 AS rel FROM corpus_record WHERE ordinal % {QUERY_STEP} = 0",
    "build_rates": _DOCS + _SIZES + """, x AS (SELECT (SELECT count(*) FROM dl) AS d, (SELECT coalesce(sum(strlen(external_id)), 0) FROM dl) AS ids, (SELECT coalesce(sum(24 + strlen(term)), 0) FROM dict) AS t, (SELECT coalesce(sum(vbyte_bytes + 8), 0) FROM bs) AS vb, (SELECT count(*) FROM p) AS np, (SELECT sum(strlen(text)) FROM documents) AS ib)
 SELECT documents / 2 AS documents_per_second, total / 2 AS tokens_per_second, np / 2 AS postings_per_second, round(ib / 1048576 / 2, 9) AS input_mib_per_second, round((80 + 12 + t + 12 + vb + 12 + 4 * d + 12 + 8 * (d + 1) + 12 + ids) / np, 9) AS bytes_per_posting FROM st, x""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type",
}
