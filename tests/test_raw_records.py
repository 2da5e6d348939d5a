"""The tokenizer against a plain reading of the rules, line by line."""

import random

import numpy as np
import pytest

from textloom.sources import raw_records as R


def brute(fmt, line):
    if line is None:
        return "null_line", None, None
    if fmt not in ("tsv", "csv"):
        return "unknown_format", None, None
    if line.endswith(b"\r"):
        line = line[:-1]
    if len(line) > 1_048_576:
        return "too_large", None, None
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        return "invalid_utf8", None, None
    if fmt == "tsv":
        if "\t" not in text:
            return "column_count", None, None
        fields = text.split("\t", 1)
    else:
        fields, i, n = [], 0, len(text)
        while True:
            if i < n and text[i] == '"':
                j, value = i + 1, []
                while True:
                    if j >= n:
                        return "broken_quoting", None, None
                    if text[j] == '"':
                        if j + 1 < n and text[j + 1] == '"':
                            value.append('"')
                            j += 2
                            continue
                        break
                    value.append(text[j])
                    j += 1
                if j + 1 < n and text[j + 1] != ",":
                    return "broken_quoting", None, None
                fields.append("".join(value))
                i = j + 1
            else:
                j = text.find(",", i)
                j = n if j < 0 else j
                if '"' in text[i:j]:
                    return "broken_quoting", None, None
                fields.append(text[i:j])
                i = j
            if i >= n:
                break
            i += 1
            if i == n:
                fields.append("")
                break
        if len(fields) != 2:
            return "column_count", None, None
    if not fields[0]:
        return "empty_id", None, None
    if len(fields[0].encode()) > 1024:
        return "id_too_large", None, None
    return None, fields[0], fields[1]


def check(spark, rows):
    df = spark.createDataFrame(rows, "line_no long, fmt string, line binary, reason string")
    got = {r.line_no: (r.reason, r.external_id, r.text) for r in R.parse_lines(df).collect()}
    for no, fmt, line, _ in rows:
        assert got[no] == brute(fmt, None if line is None else bytes(line)), (fmt, line[:80] if line else line)


def test_random_lines(spark):
    rng = random.Random(3)
    alphabet = [b"a", b"b", b",", b'"', b"\t", b"\r", "é".encode(), b"\xff", b" ", b'""']
    rows = [(i, rng.choice(["csv", "csv", "tsv"]), bytearray(b"".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 300])))), "clash") for i in range(3000)]
    check(spark, rows)


def test_edges(spark):
    big = b"x" * 1_048_574
    lines = [b"", b"\r", b",", b"a,", b",b", b'"a""",b', b'"a', b'a"b,c', b"a,b,c", b'"a,b"', b'"a,b",""', b"a\tb\tc", b"\tb", b"a", b"k\t" + big, b"k\t" + big + b"\r", b"k\t" + big + b"x", b"k\t" + big + b"x\r", b"k\t" + big + b"xx\r", b"i" * 1024 + b"\tt", b"i" * 1025 + b"\tt", b'"' + b"q" * 5000 + b'",' + b"r" * 3000, None]
    check(spark, [(i * 3 + k, f, None if x is None else bytearray(x), None) for i, x in enumerate(lines) for k, f in enumerate(("tsv", "csv", None))])


def test_empty_table(spark):
    assert R.parse_lines(spark.createDataFrame([], "line_no long, fmt string, line binary")).count() == 0


@pytest.mark.parametrize("cut", [1, 7, 64, 200])
def test_composition_is_exact(cut):
    rng = random.Random(cut)
    data = np.frombuffer(bytes(rng.choice(b'ab,"') for _ in range(300)), np.uint8)
    kind = np.zeros(256, np.uint8)
    kind[44], kind[34] = R.SEPARATOR, R.QUOTE
    whole = R.chunk_transitions(kind[data][None, :], R.CSV)
    parts = [R.chunk_transitions(kind[x][None, :], R.CSV) for x in (data[:cut], data[cut:])]
    for a, b in zip(whole, R.compose(*parts, np.array([cut])), strict=True):
        assert (a == b).all()
