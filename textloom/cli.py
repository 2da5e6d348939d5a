"""Commands: index, query, verify, version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom import __version__
from textloom.operators.blocks import CODECS
from textloom.operators.index import build, open_index, write
from textloom.operators.search import EXECUTORS, search, search_one
from textloom.operators.verify import verify
from textloom.session import prepare
from textloom.sources.corpus import read_tsv


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build an index of a TSV corpus")
    i.add_argument("corpus")
    i.add_argument("destination")
    i.add_argument("--codec", default="vbyte", choices=CODECS)
    i.add_argument("--profile", default="english")
    q = sub.add_parser("query", help="answer one query, or a batch of TSV queries")
    q.add_argument("index")
    q.add_argument("query")
    q.add_argument("--batch", action="store_true")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--executor", default="exhaustive", choices=EXECUTORS)
    v = sub.add_parser("verify", help="check an index")
    v.add_argument("index")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Run a command; 0 if it went well, else 1 with the error on the error stream."""
    out = out or sys.stdout
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(bool(e.code))
    if args.command == "version":
        print(f"version={__version__}", file=out)
        return 0
    try:
        if args.command == "query" and args.limit <= 0:
            raise ValueError("the limit must be positive")
        spark = prepare(spark or SparkSession.builder.appName("textloom").getOrCreate())
        if args.command == "index":
            corpus = read_tsv(spark, args.corpus).withColumnRenamed("ordinal", "doc_id")
            write(build(corpus, args.profile), args.destination, args.codec)
        elif args.command == "verify":
            bad = verify(spark, args.index).filter("violations > 0").collect()
            if bad:
                raise ValueError("; ".join(f"{r.check}: {r.violations}" for r in bad))
            print("verified", file=out)
        elif args.batch:
            queries = read_tsv(spark, args.query).select(F.col("ordinal").alias("n"), F.col("external_id").alias("query_id"), "text")
            ranked = search(open_index(spark, args.index), queries, args.limit, args.executor, key="n")
            named = ranked.join(queries.select(F.col("n").alias("query_id"), F.col("query_id").alias("name")), "query_id").orderBy("query_id", "rank")
            for r in named.toLocalIterator():
                print(r.name, r.external_id, r.rank, repr(r.score), sep="\t", file=out)
        else:
            for r in search_one(open_index(spark, args.index), args.query, args.limit, args.executor).orderBy("rank").collect():
                print(r.external_id, repr(r.score), sep="\t", file=out)
    except Exception as e:  # noqa: BLE001 - every error ends the command
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
