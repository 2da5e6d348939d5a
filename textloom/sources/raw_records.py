"""Raw lines to records, or to the reason why a line gives none.

A line is read by a finite-state tokenizer that knows quotes. Lines lie in one long
byte buffer that is cut into chunks of equal length; for each chunk the tokenizer
runs from every state it might start in, for all chunks of a batch at once, and gives
a transition: end state, number of separators, place of the first one and place of
the first error, for each start state. Transitions of neighbouring chunks compose
(an associative product), so a line of a mebibyte costs as much per byte as a short
one, and no byte is looked at by a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINE = 1_048_576
MAX_ID = 1_024
CHUNK = 256
#: Bytes of lines that are tokenized at once.
BATCH_BYTES = 1 << 22

# States: 0 at the start of a field, 1 in a plain field, 2 in quotes, 3 after a quote within quotes, 4 failed.
START, PLAIN, QUOTED, CLOSING, FAILED = range(5)
# Byte classes: 0 other, 1 separator, 2 quote, 3 padding behind the line's end.
OTHER, SEPARATOR, QUOTE, PAD = range(4)
CSV = np.array(
    [
        [PLAIN, START, QUOTED, START],
        [PLAIN, START, FAILED, PLAIN],
        [QUOTED, QUOTED, CLOSING, QUOTED],
        [FAILED, START, QUOTED, CLOSING],
        [FAILED, FAILED, FAILED, FAILED],
    ],
    dtype=np.uint8,
)
# tsv: quotes are ordinary, a separator keeps the state; only its first place matters.
TSV = np.array([[START, START, START, START]] + [[s] * 4 for s in range(1, 5)], dtype=np.uint8)
STATES = 5
NOWHERE = np.int64(2**62)


def chunk_transitions(classes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """For chunks (rows of byte classes): end state, separators, first separator and first error for each start state."""
    n, width = classes.shape
    state = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    seps = np.zeros((n, STATES), dtype=np.int64)
    first = np.full((n, STATES), NOWHERE)
    error = np.full((n, STATES), NOWHERE)
    for j in range(width):
        c = classes[:, j]
        after = table[state, c[:, None]]
        hit = (c == SEPARATOR)[:, None] & ((state != QUOTED) & (state != FAILED))
        np.copyto(first, j, where=hit & (seps == 0))
        seps += hit
        np.copyto(error, j, where=(after == FAILED) & (state != FAILED))
        state = after
    return state, seps, first, error


def compose(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], width: np.ndarray | int) -> tuple[np.ndarray, ...]:
    """The transition of a text followed by another; ``width`` is the length of the first."""
    rows = np.arange(len(a[0]))[:, None]
    mid = a[0]
    shift = np.asarray(width).reshape(-1, 1)
    first_b, error_b = b[2][rows, mid], b[3][rows, mid]
    first = np.where(a[1] > 0, a[2], np.where(first_b < NOWHERE, first_b + shift, NOWHERE))
    error = np.where(a[3] < NOWHERE, a[3], np.where(error_b < NOWHERE, error_b + shift, NOWHERE))
    return b[0][rows, mid], a[1] + b[1][rows, mid], first, error


def tokenize(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, separator: int) -> tuple[np.ndarray, ...]:
    """Run the tokenizer over lines of a byte buffer: end state, separators, first separator, first error of each."""
    n = len(starts)
    counts = np.maximum(1, -(-lengths // CHUNK))
    line_of = np.repeat(np.arange(n), counts)
    nth = np.arange(len(line_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = int(min(CHUNK, max(1, lengths.max(initial=1))))
    at = (starts[line_of] + nth * CHUNK)[:, None] + np.arange(width)[None, :]
    inside = at < (starts + lengths)[line_of][:, None]
    byte = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.uint8)
    kind = np.zeros(256, np.uint8)
    kind[separator], kind[ord('"')] = SEPARATOR, QUOTE
    classes = np.where(inside, kind[byte], PAD).astype(np.uint8)
    parts = chunk_transitions(classes, table)
    # Compose the chunks of a line in pairs: log2(chunks) products instead of one after the other.
    span = np.full(len(line_of), CHUNK, dtype=np.int64)
    while len(line_of) > n:
        head = np.flatnonzero(nth % 2 == 0)
        paired = np.zeros(len(line_of), bool)
        paired[:-1] = (nth[:-1] % 2 == 0) & (line_of[1:] == line_of[:-1])
        left = head[paired[head]]
        joined = compose(tuple(p[left] for p in parts), tuple(p[left + 1] for p in parts), span[left])
        merged = [p.copy() for p in parts]
        for p, j in zip(merged, joined, strict=True):
            p[left] = j
        longer = span.copy()
        longer[left] += span[left + 1]
        parts = tuple(p[head] for p in merged)
        span, line_of, nth = longer[head], line_of[head], nth[head] // 2
    return tuple(p[:, START] for p in parts)


def _valid_utf8(column: pa.Array, size: np.ndarray) -> np.ndarray:
    def ok(b: bytes) -> bool:
        try:
            b.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    try:
        pa.Array.from_buffers(pa.string() if column.type == pa.binary() else pa.large_string(), len(column), column.buffers(), offset=column.offset).validate(full=True)
        return np.ones(len(column), bool)
    except pa.ArrowInvalid:
        return np.array([True if v is None else ok(v[:n]) for v, n in zip(column.to_pylist(), size.tolist(), strict=True)], bool)


def _unquoted(b: bytes) -> bytes:
    return b[1:-1].replace(b'""', b'"') if len(b) >= 2 and b[:1] == b'"' and b[-1:] == b'"' else b


OUT = pa.schema([("line_no", pa.int64()), ("external_id", pa.string()), ("text", pa.string()), ("reason", pa.string()), ("at", pa.int64())])
OUT_DDL = "line_no long, external_id string, text string, reason string, at long"


def _batch(line_no: pa.Array, fmt: pa.Array, line: pa.Array) -> pa.RecordBatch:
    n = len(line)
    offsets = np.frombuffer(line.buffers()[1], dtype=np.int32 if line.type == pa.binary() else np.int64)[line.offset : line.offset + n + 1].astype(np.int64)
    data = np.frombuffer(line.buffers()[2], dtype=np.uint8) if line.buffers()[2] is not None else np.zeros(0, np.uint8)
    starts, size = offsets[:-1], np.diff(offsets)
    if len(data):
        ends_cr = (size > 0) & (data[np.maximum(0, np.minimum(starts + size - 1, len(data) - 1))] == 13)
        size = size - ends_cr
    null = np.asarray(line.is_null())
    kind = np.asarray(fmt.fill_null("").to_pylist(), dtype=object)
    tsv, csv = kind == "tsv", kind == "csv"
    valid = _valid_utf8(line, size)
    state, seps = np.zeros(n, np.uint8), np.zeros(n, np.int64)
    first, error = np.full(n, NOWHERE), np.full(n, NOWHERE)
    for mask, rule, sep in ((tsv, TSV, 9), (csv, CSV, 44)):
        idx = np.flatnonzero(mask)
        if len(idx):
            for whole, part in zip((state, seps, first, error), tokenize(data, starts[idx], size[idx], rule, sep), strict=True):
                whole[idx] = part
    broken = csv & ((state == FAILED) | (state == QUOTED))
    columns = np.where(tsv, seps >= 1, seps == 1)
    ids: list[str | None] = []
    texts: list[str | None] = []
    reasons: list[str | None] = []
    places: list[int | None] = []
    for i in range(n):
        reason, at, key, text = None, None, None, None
        if null[i]:
            reason = "null_line"
        elif not (tsv[i] or csv[i]):
            reason = "unknown_format"
        elif size[i] > MAX_LINE:
            reason, at = "too_large", MAX_LINE
        elif not valid[i]:
            reason = "invalid_utf8"
            try:
                bytes(data[starts[i] : starts[i] + size[i]]).decode("utf-8")
            except UnicodeDecodeError as e:
                at = e.start
        elif broken[i]:
            reason, at = "broken_quoting", int(error[i]) if error[i] < NOWHERE else int(size[i])
        elif not columns[i]:
            reason, at = "column_count", int(first[i]) if seps[i] else int(size[i])
        else:
            raw = data[starts[i] : starts[i] + size[i]].tobytes()
            a, b = raw[: first[i]], raw[first[i] + 1 :]
            if csv[i]:
                a, b = _unquoted(a), _unquoted(b)
            if not a:
                reason, at = "empty_id", 0
            elif len(a) > MAX_ID:
                reason, at = "id_too_large", MAX_ID
            else:
                key, text = a.decode("utf-8"), b.decode("utf-8")
        ids.append(key)
        texts.append(text)
        reasons.append(reason)
        places.append(at)
    return pa.RecordBatch.from_arrays([line_no.cast(pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(reasons, pa.string()), pa.array(places, pa.int64())], schema=OUT)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        line = batch.column("line")
        if line.type not in (pa.binary(), pa.large_binary()):
            line = line.cast(pa.large_binary())
        lengths = np.asarray(pc.binary_length(line).fill_null(0))
        # Few lines at once where they are long: memory follows BATCH_BYTES, not the number of lines.
        group = (np.cumsum(np.maximum(lengths, 64)) - 1) // BATCH_BYTES
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)])) if len(group) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _batch(batch.column("line_no").slice(a, b - a), batch.column("fmt").slice(a, b - a), line.slice(a, b - a))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Parse raw lines: (line_no, external_id, text, reason, at), one row per line.

    ``raw`` has line_no BIGINT, fmt STRING and line BINARY; other columns are ignored. A
    line gives either a record (reason is null) or the first reason that holds: too_large,
    invalid_utf8, broken_quoting (csv only), column_count, empty_id, id_too_large; ``at``
    is the byte offset at which it shows. A null line is 'null_line', a format besides tsv
    and csv 'unknown_format'. Repeated rows and equal line numbers are parsed each for
    itself. Ids aren't trimmed, texts may be empty. It is one pass without a shuffle.
    """
    # What is certainly too large isn't sent to Python: one carriage return may end a line, so one byte more is kept.
    cut = F.when(F.octet_length("line") > MAX_LINE + 2, F.substring(F.col("line"), 1, 1)).otherwise(F.col("line"))
    sure = raw.select(F.col("line_no").cast("long").alias("line_no"), "fmt", cut.alias("line"), (F.octet_length("line") > MAX_LINE + 2).alias("large"))
    large = sure.filter("large and fmt in ('tsv', 'csv')").select("line_no", F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("reason"), F.lit(MAX_LINE).cast("long").alias("at"))
    rest = sure.filter("not coalesce(large, false) or coalesce(fmt, '') not in ('tsv', 'csv')").select("line_no", "fmt", "line").mapInArrow(_parse, OUT_DDL)
    return rest.unionByName(large)


def failures(parsed: DataFrame) -> DataFrame:
    """(line_no, reason) of the lines that give no record."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_no", "reason")


def records(parsed: DataFrame) -> DataFrame:
    """(line_no, external_id, text) of the lines that give one."""
    return parsed.filter(F.col("reason").isNull()).select("line_no", "external_id", "text")
