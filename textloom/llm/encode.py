"""Token ids of every document under a public byte-level tokenizer (problem 8)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-splitting pattern of this family of tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are split before they are encoded.
LONG = 1 << 13
#: Places that always are boundaries of the pattern's matches: before a blank or line feed behind a visible ASCII sign
#: or a letter or number, and between an ASCII letter and an ASCII digit. No alternative of the pattern matches across
#: them, none looks back, and the only look ahead is for white space at the end of a piece, which these places exclude.
SAFE = re.compile(r"(?:(?<=[!-~])|(?<=[^\W_]))(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


#: White space as the pattern's engine has it. Its look ahead is done with a stack, which a long run overflows.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def pieces(text: str, long: int = LONG) -> list[tuple[str, bool]]:
    """The text in pieces whose encodings, put together, are the text's encoding.

    A piece has about ``long`` signs, and more only where no safe boundary comes. A long run
    of white space is a piece by itself, without its last sign unless it ends the text: so
    the pattern matches it. The second value says that a piece is one match of the pattern.
    """
    if len(text) <= long:
        return [(text, False)]
    out: list[tuple[str, bool]] = []
    start = 0
    for run in [*((m.start(), m.end()) for m in BLANKS.finditer(text)), (len(text), len(text))]:
        while run[0] - start > long:
            found = SAFE.search(text, start + long, run[0])
            if not found or found.start() >= run[0]:
                break
            out.append((text[start : found.start()], False))
            start = found.start()
        if run[0] > start:
            out.append((text[start : run[0]], False))
        start = run[1] if run[1] == len(text) else run[1] - 1
        if start > run[0]:
            out.append((text[run[0] : start], True))
    return out


@lru_cache(maxsize=4)
def tokenizer(rank_file: str = RANK_FILE, pattern: str = PATTERN):
    """The tokenizer of a local rank file; it has no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, rank_file: str = RANK_FILE, pattern: str = PATTERN) -> list[int]:
    """The ids of one text; of an empty or null text the empty list."""
    if not text:
        return []
    own = tokenizer(rank_file, pattern)
    if len(text) <= LONG:
        return own.encode_ordinary(text)
    core = own._core_bpe  # one match of the pattern is merged as it is
    return [i for piece, one in pieces(text) for i in (core.encode_single_piece(piece.encode()) if one else own.encode_ordinary(piece))]


def decode_ids(ids: list[int], rank_file: str = RANK_FILE, pattern: str = PATTERN) -> bytes:
    """The raw bytes behind ids, joined before they are read as UTF-8: a token may end within a sign."""
    one = tokenizer(rank_file, pattern).decode_single_token_bytes
    return b"".join(one(i) for i in ids)


def _arrow_ids(texts: pa.Array, rank_file: str, pattern: str) -> pa.Array:
    flat: list[np.ndarray] = []
    ends = np.zeros(len(texts) + 1, dtype=np.int32)
    for i, text in enumerate(texts):
        ids = encode_text(text.as_py(), rank_file, pattern)
        ends[i + 1] = ends[i] + len(ids)
        if ids:
            flat.append(np.asarray(ids, dtype=np.int32))
    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", rank_file: str = RANK_FILE, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``out``, the ids ARRAY<INT> of ``text``: one pass in Arrow batches, no shuffle.

    Null and empty texts give the empty list; blank texts their ids. Equal texts and
    repeated rows give equal ids, each row for itself. Other columns aren't read.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                arrays = [part.column(c) for c in keep] + [_arrow_ids(part.column(text), rank_file, pattern)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema) if text not in keep else df.select(*keep).mapInArrow(run, schema)


def with_sizes(df: DataFrame, text: str = "text", out: str = "n_tokens", rank_file: str = RANK_FILE, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As :func:`with_ids`, but only the number of tokens BIGINT (0 for null and empty texts)."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(encode_text(t.as_py(), rank_file, pattern)) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)
