"""Ids against another library with the same vocabulary, exact round trips, and long texts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.llm import encode as E

pytestmark = pytest.mark.skipif(not Path(E.RANK_FILE).exists(), reason="the vocabulary isn't here")


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(E.RANK_FILE).with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello world", "I've 3 dogs' 'll", "<|endoftext|>", "日本語 текст ÄÖ é", "a\r\n\r\n  b\t\tc ", "²③½ 12a34", "👩‍🔬 \x00\x1c\x85", "a　b  c"]


def test_small_texts(spark, other):
    rows = [(i, t, [0]) for i, t in enumerate(TEXTS)] + [(99, None, [1]), (0, "", [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = E.with_ids(df)
    assert got.columns == ["doc_id", "ids"] and got.dtypes[1][1] == "array<int>"
    for r in got.collect():
        assert list(r.ids) == ([] if r.doc_id == 99 else other(TEXTS[r.doc_id]))
    sizes = {r.doc_id: r.n_tokens for r in E.with_sizes(df).collect()}
    assert sizes[99] == 0 and sizes[4] == len(other(TEXTS[4]))
    assert E.with_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pieces_keep_the_encoding(seed, other):
    rng = random.Random(seed)
    alphabet = ["a", "word", " ", "\n", "  ", "1", "23", "'s", "'", "é", "²", "!", "\x1c", "　", "中", "\t"]
    text = "".join(rng.choice(alphabet) for _ in range(4000))
    parts = E.pieces(text, 50)
    assert "".join(p for p, _ in parts) == text and len(parts) > 20
    own = E.tokenizer()
    assert [i for p, _ in parts for i in own.encode_ordinary(p)] == other(text)


@pytest.mark.parametrize("text", [" " * 200_000, "x" + " " * 150_000 + "y", "\n" * 100_000 + "z" + "\t" * 5000, "a" * 300_000, "中" * 100_000, "é!" * 100_000, "ab12 " * 60_000])
def test_very_long_texts(text):
    ids = E.encode_text(text)
    assert E.decode_ids(ids) == text.encode()


def test_long_white_space_is_one_match(other):
    for text in ("x" + " " * 9000 + "y" + "\n" * 9000, " " * 9000 + "y", "x" + "　" * 9000):
        assert E.encode_text(text) == other(text)


def test_round_trip_of_a_table(spark):
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("the test tables are not here")
    df = spark.read.parquet(str(path))
    ids = {r.doc_id: r.ids for r in E.with_ids(df).collect()}
    for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        assert E.decode_ids(list(ids[r.doc_id])) == r.t.encode()
