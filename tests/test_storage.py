"""Written indexes, their checks under damage, the commands, the service function and the stream."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.api import search_api
from textloom.cli import main
from textloom.operators.index import Index, build, kept, open_index, write
from textloom.operators.verify import block_violations, verify, violations
from textloom.sources import corpus, wiki
from textloom.streaming.segments import append_segments, late_counts, open_segments

ROWS = [(0, "a", "Fast search index"), (1, "a", "small search index"), (2, "b", "disk disk disk"), (3, "c", None)]


@pytest.fixture(scope="module")
def index(spark):
    return kept(build(spark.createDataFrame(ROWS, "doc_id long, external_id string, text string"), "english"))


def bad(df):
    return {r.check for r in df.filter("violations > 0").collect()}


@pytest.mark.parametrize("codec", ["raw", "vbyte"])
def test_write_open_verify(spark, index, tmp_path, codec):
    path = f"file://{tmp_path}/index"
    write(index, path, codec)
    assert bad(verify(spark, path)) == set()
    again = open_index(spark, path)
    assert sorted(again.terms.collect()) == sorted(index.terms.collect()) and again.profile == "english"
    with pytest.raises(FileExistsError):
        write(index, path, codec)
    spark.read.parquet(f"{path}/terms").withColumn("df", F.col("df") + 1).write.parquet(f"{path}/terms2")
    import shutil

    shutil.rmtree(tmp_path / "index" / "terms")
    (tmp_path / "index" / "terms2").rename(tmp_path / "index" / "terms")
    assert {"checksum_terms", "term_counts"} <= bad(verify(spark, path))


def test_damage_is_found(index):
    d, p, t, s = index.documents, index.postings, index.terms, index.shards
    when = lambda df, c, cond, value: df.withColumn(c, F.when(F.expr(cond), F.lit(value)).otherwise(F.col(c)))
    cases = {
        "document_ids_distinct": Index(d.unionByName(d.limit(1)), p, t, s, "english"),
        "external_ids": Index(when(d, "external_id", "doc_id = 0", ""), p, t, s, "english"),
        "document_totals": Index(when(d, "length", "doc_id = 2", 9), p, t, s, "english"),
        "postings_frequencies": Index(d, when(p, "tf", "doc_id = 2", 0), t, s, "english"),
        "term_counts": Index(d, p, when(t, "max_tf", "term = 'disk'", 2), s, "english"),
        "dictionary_of_postings": Index(d, p, t.filter("term <> 'disk'"), s, "english"),
        "postings_distinct": Index(d, p.unionByName(p.filter("term = 'disk'")), t, s, "english"),
        "postings_documents": Index(d.filter("doc_id <> 2"), p, t, s, "english"),
        "shards": Index(d, p, t, s.filter("term <> 'disk'"), "english"),
    }
    assert bad(violations(index)) == set()
    for name, broken in cases.items():
        assert name in bad(violations(broken)), name


def test_damaged_blocks_are_found(spark, index):
    from textloom.operators.blocks import posting_blocks

    made = posting_blocks(index.postings)
    assert bad(block_violations(index, made, "vbyte")) == set()
    cut = made.withColumn("payload", F.when(F.col("term") == "disk", F.substring("payload", 1, 1)).otherwise(F.col("payload")))
    assert {"blocks_decode", "blocks_hold_postings"} <= bad(block_violations(index, cut, "vbyte"))
    moved = made.withColumn("last_doc_id", F.col("last_doc_id") + 1)
    assert "blocks_decode" in bad(block_violations(index, moved, "vbyte"))


def test_commands(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tFast search index\r\nb\tsmall search\tindex\nc\t\n")
    (tmp_path / "q.tsv").write_text("q1\tsearch small\nq2\tfast\n")
    out = io.StringIO()
    assert main(["index", f"file://{tmp_path}/c.tsv", f"file://{tmp_path}/i"], spark, out) == 0
    assert main(["query", f"file://{tmp_path}/i", "fast"], spark, out) == 0
    assert out.getvalue().split("\t")[0] == "a"
    out = io.StringIO()
    assert main(["query", "--batch", f"file://{tmp_path}/i", f"file://{tmp_path}/q.tsv"], spark, out) == 0
    assert [tuple(x.split("\t")[:3]) for x in out.getvalue().splitlines()] == [("q1", "b", "1"), ("q1", "a", "2"), ("q2", "a", "1")]
    out = io.StringIO()
    assert main(["verify", f"file://{tmp_path}/i"], spark, out) == 0 and out.getvalue() == "verified\n"
    assert main(["version"], spark, io.StringIO()) == 0
    assert main(["query", "--limit", "0", f"file://{tmp_path}/i", "x"], spark, out) == 1
    (tmp_path / "bad.tsv").write_text("a\tx\nno tab\n")
    assert main(["index", f"file://{tmp_path}/bad.tsv", f"file://{tmp_path}/j"], spark, out) == 1
    assert not (tmp_path / "j").exists()


def test_tsv(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"p{i}.tsv").write_bytes(b"".join(b"id%d\tline %d of %d\rx\n" % (j, j, i) for j in range(50 * (i + 1))))
    rows = corpus.read_tsv(spark, f"file://{tmp_path}").orderBy("ordinal").collect()
    want = [(f"id{j}", f"line {j} of {i}\rx") for i in range(5) for j in range(50 * (i + 1))]
    assert [(r.external_id, r.text) for r in rows] == want and [r.ordinal for r in rows] == list(range(len(want)))
    (tmp_path / "bad").mkdir()
    big = b"k\t" + b"x" * 1_048_574
    (tmp_path / "bad" / "b.tsv").write_bytes(b"\n".join([b"a\t", b"none", b"\tx", b"\xff\tx", big + b"\r", big + b"y", b"i" * 1025 + b"\tx", b"last\tx"]))
    got = corpus.read_tsv(spark, f"file://{tmp_path}/bad", strict=False).orderBy("ordinal").collect()
    assert [r.reason for r in got] == [None, "column_count", "empty_id", "invalid_utf8", None, "too_large", "id_too_large", None]
    with pytest.raises(corpus.RecordError, match="record 1: column_count"):
        corpus.read_tsv(spark, f"file://{tmp_path}/bad")
    with pytest.raises(corpus.RecordError):
        corpus.write_tsv(spark.createDataFrame([("a\tb", "x")], "external_id string, text string"), f"file://{tmp_path}/w")


def test_wiki(spark, tmp_path):
    pairs = [(1, 0, "One  Title", " a\n b c ", None), (2, 4, "x", "y", ""), (3, 0, "", "y", None), (4, 0, "Big", "z" * 1_048_576, None)]
    lines = []
    for i, ns, title, text, opening in pairs:
        lines += [json.dumps({"index": {"_id": str(i)}}), json.dumps({"page_id": i, "namespace": ns, "title": title, "text": text, "opening_text": opening})]
    import bz2

    (tmp_path / "d.json.bz2").write_bytes(bz2.compress(("\n".join(lines) + "\n").encode()))
    articles = wiki.read_dump(spark, f"file://{tmp_path}/d.json.bz2")
    assert {(r.page_id, r.reason) for r in wiki.skip_reason(articles).collect()} == {(1, None), (2, "namespace"), (3, "empty"), (4, "too_large")}
    row = wiki.to_corpus(articles).first()
    assert tuple(row) == ("1", "One Title", "a b c", "a b c", "https://simple.wikipedia.org/wiki/One__Title")
    (tmp_path / "broken.json").write_text('{"index":{"_id":"1"}}\n{"page_id":2}\n')
    with pytest.raises(Exception, match="without its pair"):
        wiki.read_dump(spark, f"file://{tmp_path}/broken.json").collect()


def test_catalog_and_service(spark, index):
    good = [("a", "A", "first", "https://x.example/a"), ("b", "B", "second", "")]
    catalog = spark.createDataFrame(good, wiki.CATALOG)
    assert wiki.catalog_errors(catalog).count() == 0
    wrong = spark.createDataFrame([*good, ("a", "again", "", ""), ("", "x", "", ""), ("d", "", "", ""), ("e", "e", "", "http://x.example"), ("f", "f", "", "https://"), (None, None, None, None)], wiki.CATALOG)
    assert sorted(r.error for r in wiki.catalog_errors(wrong).collect()) == ["address", "address", "no id", "no id", "no title", "repeated id"]
    status, body = search_api(index, catalog, '{"query": "searching", "limit": 2}')
    assert status == 200 and [r["title"] for r in json.loads(body)["results"]] == ["A", "A"]
    assert search_api(index, catalog, '{"query": "x", "limit": 21}')[0] == 400
    assert search_api(index, catalog, "{" + " " * 9000)[0] == 400 and search_api(index, catalog, "[]")[0] == 400
    assert search_api(index, catalog.filter("external_id <> 'b'"), '{"query": "disk"}')[0] == 500
    with pytest.raises(Exception, match="no catalog row"):
        wiki.enriched(spark.createDataFrame([("zz",)], "external_id string"), catalog, must=True).collect()


def test_server(index, spark):
    import threading
    import urllib.error
    import urllib.request

    from textloom.api import serve

    catalog = spark.createDataFrame([("a", "A", "", ""), ("b", "B", "", "")], wiki.CATALOG)
    server = serve(index, catalog, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{at}/v1/search", b'{"query": "disk"}')) as r:
            assert [x["title"] for x in json.loads(r.read())["results"]] == ["B"]
        for path, body, status in (("/v1/search", b"x", 400), ("/other", b"{}", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(urllib.request.Request(at + path, body))
            assert e.value.code == status
    finally:
        server.shutdown()


def test_stream(spark, index, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, external_id string, text string")
    for half in (0, 1):
        df.filter(F.col("doc_id") % 2 == half).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        append_segments(stream, f"{tmp_path}/out", f"{tmp_path}/check", "english").awaitTermination()
    grown = open_segments(spark, f"{tmp_path}/out", "english")
    assert sorted(grown.terms.collect()) == sorted(index.terms.collect())
    assert grown.stats.first() == index.stats.first()
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:10:00", None)], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.k or "", r.n) for r in late_counts(events, "t", "k").collect()) == [("", 1), ("a", 2)]


def test_observations_and_judgements(spark, tmp_path):
    from textloom.operators.index import index_digest
    from textloom.sources import observations as o

    df = spark.createDataFrame([(1, "raw", "x", 10, "q", "ok", 3, 5, "d1"), (2, "raw", "x", 10, "q", "ok", 3, 5, "d2")], "repetition int, codec string, executor string, k int, query_id string, status string, results int, nanoseconds long, digest string")
    o.write_observations(df, f"file://{tmp_path}/o")
    back = o.read_observations(spark, f"file://{tmp_path}/o")
    assert back.count() == 2 and o.same_results(back).first().digests == 2
    with pytest.raises(Exception, match="(?i)exist"):
        o.write_observations(df, f"file://{tmp_path}/o")
    (tmp_path / "q.txt").write_text("1 0 d1 1\n1\t0\td2\t0\n\n")
    assert sorted(map(tuple, o.read_qrels(spark, f"file://{tmp_path}/q.txt").collect())) == [("1", "d1", 1), ("1", "d2", 0)]
    (tmp_path / "r.txt").write_text("1 Q0 d1 1 -1 tag\n")
    assert tuple(o.read_run(spark, f"file://{tmp_path}/r.txt").first()) == ("1", "d1", 1)
    rows = spark.createDataFrame(ROWS, "doc_id long, external_id string, text string")
    for i, parts in enumerate((1, 3)):
        write(build(rows.repartition(parts)), f"file://{tmp_path}/i{i}")
    assert index_digest(spark, f"file://{tmp_path}/i0") == index_digest(spark, f"file://{tmp_path}/i1")


def test_late_rows_are_left_out(spark, tmp_path):
    """One file per batch: a row behind the watermark of the batch before the last isn't counted."""
    schema = "t timestamp, k string"
    for i, times in enumerate((["2024-01-01 00:10:00"], ["2024-01-01 05:00:00"], ["2024-01-01 05:05:00"], ["2024-01-01 00:20:00", "2024-01-01 05:10:00"])):
        rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("t"), F.lit("a").alias("k"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for p in (tmp_path / "in" / str(i)).glob("*.parquet"):
            os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))  # the stream reads files in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = late_counts(stream, "t", "k").writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.start), r.n) for r in spark.sql("select * from late").collect()}
    assert ("2024-01-01 00:00:00", 1) in got and ("2024-01-01 00:00:00", 2) not in got
