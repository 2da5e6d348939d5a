"""How often every term occurs, and in how many records: compressed bitmaps per term (problem 2).

A term's record identifiers are kept in containers of 65,536 neighbouring ones: sorted
16-bit places while there are fewer than 4,096, else a bitmap of 8 KiB. Beside a container lie
the occurrences, one count per identifier in order. Containers merge by union; an
identifier on both sides keeps the larger count, so rows delivered again change nothing.
As the key of the shuffle is (term, container), a term of all records is spread over
all tasks, and what is merged in one place is bounded by the size of a container.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import terms_of

SPAN_BITS = 16
SPARSE = 4_096
BITMAP_BYTES = 8_192
#: Postings that a task holds before it writes containers.
HELD = 1_000_000
#: The identifiers of all records that have a term lie under this key; a term is never empty.
ANY = ""

CONTAINERS = "term string, part long, ids binary, counts binary"
_SCHEMA = pa.schema([("term", pa.string()), ("part", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_WIDTHS = {1: np.uint8, 4: np.uint32, 8: np.int64}


def pack(places: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A container of sorted distinct places below 65,536 and their counts; counts that are all 1 take no room."""
    if len(places) < SPARSE:
        ids = places.astype("<u2").tobytes()
    else:
        bits = np.zeros(1 << SPAN_BITS, np.uint8)
        bits[places] = 1
        ids = np.packbits(bits, bitorder="little").tobytes()
    top = int(counts.max(initial=1))
    if top == 1 and int(counts.min(initial=1)) == 1:
        return ids, b""
    width = 1 if top < 256 else 4 if top < 2**32 else 8
    return ids, counts.astype(_WIDTHS[width]).tobytes()


def unpack(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places and counts of a container."""
    if len(ids) == BITMAP_BYTES:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(ids, np.uint8), bitorder="little"))
    else:
        places = np.frombuffer(ids, "<u2").astype(np.int64)
    if not counts:
        return places, np.ones(len(places), np.int64)
    return places, np.frombuffer(counts, _WIDTHS[len(counts) // len(places)]).astype(np.int64)


def union(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """The union of containers; an identifier of several keeps its largest count."""
    if len(parts) == 1:
        return parts[0]
    if all(not c for _, c in parts) and all(len(i) == BITMAP_BYTES for i, _ in parts):
        merged = np.bitwise_or.reduce([np.frombuffer(i, np.uint8) for i, _ in parts])
        return merged.tobytes(), b""
    places, counts = (np.concatenate(x) for x in zip(*(unpack(*p) for p in parts), strict=True))
    order = np.lexsort((-counts, places))
    places, counts = places[order], counts[order]
    keep = np.concatenate(([True], places[1:] != places[:-1]))
    return pack(places[keep], counts[keep])


def cardinality(ids: bytes) -> int:
    """The number of identifiers of a container."""
    if len(ids) == BITMAP_BYTES:
        return int(np.bitwise_count(np.frombuffer(ids, np.uint64)).sum())
    return len(ids) // 2


def _containers(names: list[str], code: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Postings (code of term, identifier, count) to containers, one per (term, part)."""
    order = np.lexsort((-count, key, code))
    code, key, count = code[order], key[order], count[order]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (key[1:] != key[:-1])))
    code, key, count = code[new], key[new], count[new]
    part, place = key >> SPAN_BITS, key & ((1 << SPAN_BITS) - 1)
    heads = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (part[1:] != part[:-1]))))
    ends = np.append(heads[1:], len(code))
    ids, counts = [], []
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        x, y = pack(place[a:b], count[a:b])
        ids.append(x)
        counts.append(y)
    return pa.RecordBatch.from_arrays([pa.array([names[c] for c in code[heads].tolist()], pa.string()), pa.array(part[heads]), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], schema=_SCHEMA)


class _Held:
    """Postings of a task, written as containers whenever there are ``HELD``."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.codes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def code(self, terms: Iterable[str]) -> np.ndarray:
        codes, names = self.codes, self.names
        out = []
        for t in terms:
            c = codes.get(t)
            if c is None:
                c = codes[t] = len(names)
                names.append(t)
            out.append(c)
        return np.asarray(out, np.int64)

    def add(self, code: np.ndarray, key: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((code, key, count))
        self.n += len(code)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            whole = _containers(self.names, *(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)
        self.__init__()


def _from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            terms = terms_of(text.as_py())
            if not terms:
                continue
            code, count = np.unique(held.code(terms), return_counts=True)
            code = np.append(code, held.code((ANY,)))
            held.add(code, np.full(len(code), key, np.int64), np.append(count, 1).astype(np.int64))
            if held.n >= HELD:
                yield from held.flush()
    yield from held.flush()


def _from_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for batch in batches:
        if batch.num_rows:
            held.add(held.code(batch.column(0).to_pylist()), np.asarray(batch.column(1), np.int64), np.asarray(batch.column(2), np.int64))
        if held.n >= HELD:
            yield from held.flush()
    yield from held.flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (term, part): one row for each, by union."""
    now: tuple[str, int] | None = None
    waiting: list[tuple[bytes, bytes]] = []
    out: list[tuple[str, int, bytes, bytes]] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    for batch in batches:
        for term, part, ids, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (term, part) != now:
                if now is not None:
                    out.append((*now, *union(waiting)))
                now, waiting = (term, part), []
            waiting.append((ids, counts))
            if len(waiting) >= 64:
                waiting = [union(waiting)]
        if len(out) >= 10_000:
            yield batch_of()
    if now is not None:
        out.append((*now, *union(waiting)))
    if out:
        yield batch_of()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = batch.column("ids").to_pylist(), batch.column("counts").to_pylist()
        n = [cardinality(i) for i in ids]
        total = [k if not c else int(unpack(i, c)[1].sum()) for k, i, c in zip(n, ids, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=["term", "n", "total"])


def merge(containers: DataFrame) -> DataFrame:
    """One container for each (term, part)."""
    return containers.repartition("term", "part").sortWithinPartitions("term", "part").mapInArrow(_merged, CONTAINERS)


def of_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Merged containers of the terms of texts. Null keys are left out; null, empty and letterless texts have no terms."""
    return merge(df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(_from_texts, CONTAINERS))


def of_counts(df: DataFrame, term: str, key: str, count: str) -> DataFrame:
    """Merged containers of rows that hold a term's count in a record; rows with a null are left out."""
    whole = df.select(F.col(term).alias("term"), F.col(key).cast("long").alias("key"), F.col(count).cast("long").alias("count")).dropna()
    return merge(whole.mapInArrow(_from_counts, CONTAINERS))


def frequencies(containers: DataFrame) -> DataFrame:
    """(term, records, occurrences) from merged containers, the key ANY included."""
    sizes = containers.mapInArrow(_sizes, "term string, n long, total long")
    return sizes.groupBy("term").agg(F.sum("n").alias("records"), F.sum("total").alias("occurrences"))


def marked(freq: DataFrame, measure: str, n_records: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """The terms with ``mark``: 'rare' below a count, 'common' above a share of all records, else null.

    ``n_records`` is one row with the column n.
    """
    m = F.col(measure)
    mark = F.when(m < rare_below, "rare").when(m > F.lit(common_above) * F.col("n"), "common")
    return freq.filter(F.col("term") != ANY).crossJoin(F.broadcast(n_records)).withColumn("mark", mark).drop("n")
