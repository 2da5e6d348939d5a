"""Near-duplicate texts by an LSH forest (problem 3).

Each text is a set of hashed word shingles. 64 min-hashes give 16 orders of four
values each and a sketch of a byte per value. In each order all texts are sorted by
their first value (a range partitioning that may cut a frequent value), and texts
that share it lie side by side. The depth of a region is what its crowd asks for:

* at most ``direct`` texts with the same first value meet at once;
* more are grouped by their first and each of six further values, and meet there, if a group
  has at most ``direct`` texts; where it has more, by six more values, down to the fifth level.
  That takes place where they lie side by side, or, if a partition or window may have cut
  them, after a shuffle by first and further value;
* what stays crowded, such as texts made from one template, meets by rarity: the
  shingles of these texts are counted, and two texts are candidates if they share one
  of their rarest shingles and what follows in both can still reach the threshold. That
  loses no pair at any similarity from the threshold on, and work ends at the template,
  not at the square of its texts.

A pair at similarity 0.5 is missed by the first two with 1.5e-5 where nothing is crowded and 4e-5 where all levels are. Where texts meet
directly, their sketches filter; candidates are checked exactly against the shingle sets.

The disk holds the sets once. Four orders are shuffled at a time, the sets that are asked for
a quarter at a time, and shuffle files and tables go when the step that needed them has ended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import terms_of
from textloom.llm.lookalike import consistent, rewriter
from textloom.llm.pairs import BLOCK, blocked, linked_pairs
from textloom.operators.skew import lookup_join
from textloom.session import discard, shuffles_dropped, stored, tables, written

ORDERS, DEPTH = 16, 4
VALUES = ORDERS * DEPTH
#: At most this many texts of a region meet at once.
DIRECT = 500
#: Classes, and texts with links, above this share are joined in place.
HOT_SHARE = 1e-3
#: Bytes kept of a shingle's hash: two sets of 500 shingles have one false common shingle with 2e-7.
KEPT = 5
#: Further values: the others of the order and of the next one.
FURTHER = 2 * (DEPTH - 1)
#: Levels of a crowded region: the first value, and as many further ones as are asked for below.
LEVELS = 5
#: Orders that are shuffled at a time, and parts of the sets that are shuffled one after the other.
TOGETHER, PARTS = 4, 4
#: Rows of a sorted order that are looked at at once.
WINDOW = 100_000
#: Sets that a task remembers to have sent already.
SEEN = 200_000
SKETCH_BYTES = VALUES

_UPPER = np.uint64(2**64 - 2 ** (64 - 8 * KEPT))
_rng = np.random.default_rng(20240)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """The sorted distinct hashes of ``size`` consecutive words, of which the upper bytes are kept; ``known`` keeps hashes of words."""
    if len(known) > 500_000:
        known.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = known.get(w)
        if v is None:
            v = known[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = v
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _MIX[0]
    for j in range(1, size):
        total += h[j : j + n] * _MIX[j]
    return np.unique(_finish(total) & _UPPER)


def packed(hashes: np.ndarray) -> bytes:
    """The upper bytes of sorted hashes."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The hashes, the lower bytes 0."""
    wide = np.zeros((len(raw) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT)
    return wide.view(">u8").ravel().astype(np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The min-hashes of 32 bits of a non-empty set."""
    hashes = _finish(hashes)
    out = np.full(VALUES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        # Of a product with a mixed hash, the upper half is as good as a new hash.
        part = hashes[at : at + 4096, None] * _A[None, :] + _B[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def agreement_needed(threshold: float) -> int:
    """Values of a sketch that must agree: four standard deviations below what the threshold gives."""
    p = threshold + (1 - threshold) / 256
    return int(np.floor(VALUES * p - 4 * np.sqrt(VALUES * p * (1 - p))))


FEATURES = "key long, digest binary, n int, hashes binary, first array<int>, sketch binary"


def features(df: DataFrame, key: str, columns: list[str], size: int, min_words: int, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(key, digest, n, hashes, first, sketch) of the texts with at least ``min_words`` words.

    A text is its ``columns`` in their consistent form, null as empty, with a space between.
    ``first`` has the first value of each order, ``sketch`` the lowest byte of each value.
    A set that a task has sent before comes with these and the hashes null, so copies of a text are small rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen: set[bytes] = set()
        rewrite = rewriter(rules)
        names = ["key", "digest", "n", "hashes", "first", "sketch"]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for k, *texts in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
                words = terms_of(" ".join(consistent(t, rewrite) or "" for t in texts))
                if k is None or len(words) < max(min_words, size):
                    continue
                s = shingles(words, size, known)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest in seen:
                    rows.append((k, digest, len(s), None, None, None))
                else:
                    values = min_hashes(s)
                    rows.append((k, digest, len(s), packed(s), values[::DEPTH].view(np.int32), values.astype(np.uint8).tobytes()))
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(digest)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return df.select(F.col(key).cast("long").alias(key), *columns).mapInArrow(run, FEATURES)


def _orders(texts: DataFrame, start: int) -> DataFrame:
    """(key, digest, sketch): one row per text and order from ``start`` on, ``TOGETHER`` of them; the key is the order with its first value."""
    each = texts.select("digest", "sketch", F.posexplode(F.slice("first", start + 1, TOGETHER)).alias("order", "value"))
    key = F.shiftleft((F.col("order") + start).cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(2**32 - 1)))
    return each.select(key.alias("key"), "digest", "sketch")


_FOUND = "key long, a binary, b binary"


def _joined(column: pa.ChunkedArray, width: int) -> bytes:
    """The bytes of a column of equally long values, one after the other, without a Python object for each."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            start = int(np.frombuffer(chunk.buffers()[1], np.int32, 1, 4 * chunk.offset)[0])
            parts.append(memoryview(chunk.buffers()[2])[start : start + width * len(chunk)])
    return b"".join(parts)


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(_joined(table.column("sketch"), SKETCH_BYTES), np.uint64).reshape(table.num_rows, SKETCH_BYTES // 8)


def _apart(x: np.ndarray) -> np.ndarray:
    """How many bytes of the xor of two sketches' words aren't 0."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count((((x & low) + low) | x) & ~low)


def _agree(left: np.ndarray, right: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of each row of ``left`` and each of ``right`` whose sketches agree."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, 65_536 // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        differ = np.zeros((len(part), len(right)), np.uint16)
        for w in range(SKETCH_BYTES // 8):
            differ += _apart(part[:, w, None] ^ right[None, :, w])
        i, j = np.nonzero(differ <= VALUES - needed)
        found.append((i + at, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _within(head: np.ndarray, size: np.ndarray, sketch: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b), a < b, of all rows of a group whose sketches agree; groups start at ``head``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s in np.unique(size[size > 1]).tolist():
        at = head[size == s]
        if s > 64:
            for h in at.tolist():
                i, j = _agree(sketch[h : h + s], sketch[h : h + s], needed)
                found.append((h + i[i < j], h + j[i < j]))
            continue
        i, j = np.triu_indices(s, 1)
        step = max(1, 65_536 // len(i))
        for k in range(0, len(at), step):
            a, b = ((at[k : k + step, None] + x[None, :]).ravel() for x in (i, j))
            keep = _apart(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.uint16) <= VALUES - needed
            found.append((a[keep], b[keep]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _heads(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal rows."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    head = np.append(0, np.flatnonzero(change) + 1)
    return head, np.diff(np.append(head, n))


def _digest_pairs(table: pa.Table, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The digests of the rows a and b, the lesser one first, each two once."""
    digest = np.frombuffer(_joined(table.column("digest"), 16), ">u8").reshape(-1, 2)
    x, y = digest[a], digest[b]
    swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    both = np.unique(np.concatenate([digest[a], digest[b]], axis=1), axis=0)
    both = both[(both[:, :2] != both[:, 2:]).any(axis=1)]
    column = lambda v: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(v), [None, pa.py_buffer(v.astype(">u8").tobytes())]).cast(pa.binary())
    return column(both[:, :2]), column(both[:, 2:])


def _once(table: pa.Table) -> pa.Table:
    """Rows sorted by key and digest without those that repeat the one before: a set that several tasks sent."""
    digest = np.frombuffer(_joined(table.column("digest"), 16), np.uint64).reshape(-1, 2)
    keys = np.asarray(table.column("key"))
    again = np.append(False, (keys[1:] == keys[:-1]) & (digest[1:] == digest[:-1]).all(axis=1))
    return table.take(pa.array(np.flatnonzero(~again))) if again.any() else table


#: By level and order: where the further values lie in a sketch. The first value is level 1; each level has values of its own.
_FURTHER_AT = {level: np.array([[(o + 2 * (level - 2) + n) % ORDERS * DEPTH + d for n in (0, 1) for d in range(1, DEPTH)] for o in range(ORDERS)]) for level in range(2, LEVELS + 1)}


def _below(sketch: np.ndarray, rows: np.ndarray, group: np.ndarray, order: np.ndarray, level: int, needed: int, direct: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Groups of ``rows``, sorted by ``group``, by each further value: index pairs that meet there or on the levels below, and rows that stay crowded.

    A group is a template's if most of it stays together: if, by more than two of its six further values,
    as many rows lie in crowded groups of over a third of it. Going deeper wouldn't part it.
    """
    own, size = sketch[rows], _heads(group)[1]
    place = np.repeat(np.arange(len(size)), size)
    kept = np.zeros(len(size))
    pairs, on = [], []
    for d in range(FURTHER):
        further = own.view(np.uint8)[np.arange(len(rows)), _FURTHER_AT[level][order, d]]
        by = np.lexsort((further, place))
        start, count = _heads(place[by], further[by])
        fits = count <= direct
        a, b = _within(start[fits], count[fits], own[by], needed)
        pairs.append((rows[by[a]], rows[by[b]]))
        full = np.repeat(~fits, count)
        kept += np.bincount(place[by[np.repeat(~fits & (count * 3 > size[place[by[start]]]), count)]], minlength=len(size))
        on.append((by[full], np.repeat(np.arange(len(start)), count)[full]))
    template = (kept > 2 * size) | (level == LEVELS)
    crowded = []
    for by, parted in on:
        stays = template[place[by]]
        crowded.append(rows[by[stays]])
        by, parted = by[~stays], parted[~stays]
        if len(by):
            more, left = _below(sketch, rows[by], parted, order[by], level + 1, needed, direct)
            pairs += more
            crowded += left
    return pairs, crowded


def _further_key(keys: np.ndarray, further: np.ndarray, d: int) -> np.ndarray:
    """The key of a group by first and further value, the order in its lowest bits."""
    mixed = _finish(_finish(keys.astype(np.uint64)) ^ (further.astype(np.uint64) | np.uint64(d << 32)))
    return ((mixed & ~np.uint64(ORDERS - 1)) | (keys >> 32).astype(np.uint64)).view(np.int64)


def _walk(needed: int, direct: int, window: int):
    """Candidates (a, b) of rows sorted by key; (key, digest, sketch) for each further value of a text in a group that may be cut, or that stays crowded.

    The sketch is null where it stays crowded: nothing is to meet there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        # The group that the start of the partition or the end of a window may have cut.
        parted: int | None = None

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, parted
            table = _once(pa.Table.from_batches(held).combine_chunks())
            keys = np.asarray(table.column("key"))
            head, size = _heads(keys)
            parted = int(keys[0]) if parted is None else parted
            cut_off = keys[head] == parted
            if last or len(head) == 1:
                cut_off[-1] = True
                parted, end = int(keys[-1]), len(keys)
            else:
                end = int(head[-1])
                head, size, cut_off = head[:-1], size[:-1], cut_off[:-1]
            crowded = (size > direct) | cut_off
            rest = table.slice(end)
            held, rows = rest.to_batches(), rest.num_rows
            sketch = _sketches(table)
            found = [_within(head[~crowded], size[~crowded], sketch, needed)]
            digest, told = (table.column(c).combine_chunks() for c in ("digest", "sketch"))
            full, apart = (np.flatnonzero(np.repeat(c, size)) for c in (crowded & ~cut_off, cut_off))
            if len(full):
                pairs, left = _below(sketch, full, keys[full], keys[full] >> 32, 2, needed, direct)
                found += pairs
                full = np.unique(np.concatenate(left))
            for at, told_of in ((full, None), (apart, told)):
                for d in range(FURTHER if len(at) else 0):
                    key = _further_key(keys[at], sketch.view(np.uint8)[at, _FURTHER_AT[2][keys[at] >> 32, d]], d)
                    yield pa.RecordBatch.from_arrays([pa.array(key), digest.take(pa.array(at)), told_of.take(pa.array(at)) if told_of is not None else pa.nulls(len(at), pa.binary())], names=["key", "a", "b"])
            a, b = _digest_pairs(table, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), a, b], names=["key", "a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= window:
                yield from cut(False)
        if rows:
            yield from cut(True)

    return run


def _meet(needed: int, direct: int, window: int):
    """Candidates (a, b) of rows sorted by (key, digest), all of a group; (a, null) for a text of a group that stays crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = _once(pa.Table.from_batches(held).combine_chunks())
            head, size = _heads(np.asarray(table.column("key")))
            end = table.num_rows
            if not last:
                end = int(head[-1])
                head, size = head[:-1], size[:-1]
            rest = table.slice(end)
            held, rows = rest.to_batches(), rest.num_rows
            sketch, crowded = _sketches(table), size > direct
            found, left = [_within(head[~crowded], size[~crowded], sketch, needed)], [np.zeros(0, np.int64)]
            full = np.flatnonzero(np.repeat(crowded, size))
            if len(full):
                keys = np.asarray(table.column("key"))[full]
                pairs, still = _below(sketch, full, keys, keys & (ORDERS - 1), 3, needed, direct)
                found += pairs
                left += still
            a, b = _digest_pairs(table, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])
            left = np.unique(np.concatenate(left))
            if len(left):
                yield pa.RecordBatch.from_arrays([table.column("digest").combine_chunks().take(pa.array(left)), pa.nulls(len(left), pa.binary())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= window:
                yield from cut(False)
        if rows:
            yield from cut(True)

    return run


def _positions(threshold: float, window: int):
    """Candidates (a, b) of rows (h, i, j, own, digest, n, at) sorted by (h, i, j): block i of a shingle's texts meets block j, or itself.

    ``at`` is the place of the shingle among those of its text, rare ones first. Two texts can
    have no more in common than this shingle and what follows it in the shorter rest.
    """

    def reach(n: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, 1_000_000 // max(1, len(y)))
        for k in range(0, len(x), step):
            a, b = x[k : k + step, None], y[None, :]
            most = np.minimum(n[a] - at[a], n[b] - at[b])
            i, j = np.nonzero((most * (1 + threshold) >= threshold * (n[a] + n[b]) - 1e-6) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])))
            found.append((x[k + i], y[j]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            h, left, right, own, n, at = (np.asarray(table.column(c)) for c in ("h", "i", "j", "own", "n", "at"))
            n, at = n.astype(np.float64), at.astype(np.float64)
            head, size = _heads(h, left, right)
            end = table.num_rows
            if not last:
                end = int(head[-1])
                head, size = head[:-1], size[:-1]
            rest = table.slice(end)
            held, rows = rest.to_batches(), rest.num_rows
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for s, z in zip(head.tolist(), size.tolist(), strict=True):
                if left[s] == right[s]:
                    x = np.arange(s, s + z)
                    a, b = reach(n, at, x, x)
                    found.append((a[a < b], b[a < b]))
                else:
                    found.append(reach(n, at, *(s + np.flatnonzero(own[s : s + z] == side[s]) for side in (left, right))))
            a, b = _digest_pairs(table, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= window:
                yield from cut(False)
        if rows:
            yield from cut(True)

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and shingle."""
    for batch in batches:
        if batch.num_rows:
            sets = [unpacked(h) for h in batch.column("hashes").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(rows), pa.array(np.array([len(x) for x in sets], np.int32)).take(rows), pa.array(np.concatenate(sets).view(np.int64))], names=["digest", "n", "h"])


def rare_first(texts: DataFrame, threshold: float, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (a, b) of ``texts`` (digest, hashes): all that reach the threshold, by their rarest shingles.

    Two sets with Jaccard similarity t share one of the first n - t * n + 1 shingles of each, in
    whatever order, if both have the same. Ordered by how many of the texts hold them, rare
    first, these hold the shingles of a template only behind a text's own.
    """
    each = written(texts.select("digest", "hashes").mapInArrow(_each, "digest binary, n int, h long"), "shingles")
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    total = max(1, each.count())
    counted = lookup_join(each, counts, "h", F.col("df") > F.lit(HOT_SHARE * total))
    # A text's own shingles lie in one task each; a text is as long as it is.
    order = Window.partitionBy("digest").orderBy("df", "h")
    placed = counted.withColumn("at", F.row_number().over(order) - 1).filter((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-6))))
    cut = blocked(written(placed.select("digest", "n", "h", "at"), "rare"), "h", "digest", min(block, window), 2)
    met = cut.withColumn("own", F.col("i")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "n", "at")
    return met.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_positions(threshold, window), "a binary, b binary")


def part_of(digest: str) -> Column:
    """The part of the sets that a digest lies in."""
    return F.pmod(F.xxhash64(digest), F.lit(PARTS)).cast("int")


def sets_of(texts: DataFrame, wanted: DataFrame, name: str, path: str | None = None) -> str:
    """The folder of a table (digest, n, hashes): of ``texts``, those whose digest is in ``wanted`` (digest), each once.

    The sets are shuffled part by part. ``path`` is that of ``texts``, if its parts aren't needed any more afterwards.
    """
    texts = texts if "part" in texts.columns else texts.withColumn("part", part_of("digest"))
    to = None
    for i in range(PARTS):
        own = texts.filter((F.col("part") == i) & F.col("hashes").isNotNull()).select("digest", "n", "hashes")
        some = own.join(wanted.select("digest").filter(part_of("digest") == i), "digest", "left_semi").dropDuplicates(["digest"])
        to = stored(some, name, to=to)
        if path:
            discard(texts.sparkSession, f"{path}/part={i}")
    return to


def candidates(texts: DataFrame, threshold: float, direct: int = DIRECT, window: int = WINDOW) -> DataFrame:
    """Distinct candidate pairs (a, b) of digests, a < b, of ``texts`` (:func:`features`); a digest may come several times."""
    needed, spark = agreement_needed(threshold), texts.sparkSession
    drawn = texts.filter(F.col("first").isNotNull()).select("digest", "first", "sketch")
    to = None
    for start in range(0, ORDERS, TOGETHER):
        rows = _orders(drawn, start).repartitionByRange("key", "digest").sortWithinPartitions("key", "digest")
        to = stored(rows.mapInArrow(_walk(needed, direct, window), _FOUND), "candidates", to=to)
    found = spark.read.schema(_FOUND).parquet(to)
    near = found.filter(F.col("key").isNull()).select("a", "b")
    crowded = found.filter(F.col("key").isNotNull()).select("key", F.col("a").alias("digest"), F.col("b").alias("sketch"))
    # Sizes are mergeable counts; texts of groups that no task holds are named where they are, only the others are shuffled by group.
    cut = crowded.filter(F.col("sketch").isNotNull())
    sizes = cut.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sized = lookup_join(cut, sizes, "key", F.col("size") > F.lit(HOT_SHARE * max(1, cut.count())))
    fits = F.col("size") <= window
    met = sized.filter(fits & (F.col("size") > 1)).select("key", "digest", "sketch").repartition("key").sortWithinPartitions("key", "digest")
    deep = written(met.mapInArrow(_meet(needed, direct, window), "a binary, b binary"), "deep")
    left = crowded.filter(F.col("sketch").isNull()).select("digest").unionByName(sized.filter(~fits).select("digest"))
    many = written(left.unionByName(deep.filter(F.col("b").isNull()).select(F.col("a").alias("digest"))).distinct(), "crowded")
    also = near.unionByName(deep.filter(F.col("b").isNotNull()))
    if many.isEmpty():
        return also.distinct()
    dense = rare_first(spark.read.schema("digest binary, n int, hashes binary").parquet(sets_of(texts, many, "dense")), threshold, window)
    # Two texts of crowded regions have met by rarity, which loses none: the pairs that their sketches would give aren't needed.
    for side in ("a", "b"):
        also = also.join(many.select(F.col("digest").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    also = also.filter(F.col("_a").isNull() | F.col("_b").isNull()).select("a", "b")
    return also.unionByName(dense).distinct()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True)) for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(both, pa.int32())], names=["a", "b", "na", "nb", "both"])


class NearDuplicates:
    """Classes of equal shingle sets, and pairs of classes whose sets are close enough.

    members: (key, digest); links: (a, b) of digests with similarity at or above the threshold.
    """

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every two keys whose sets are close enough, equal ones included."""
        return linked_pairs(self.links, self.members, "digest", "key")

    def groups(self) -> DataFrame:
        """(key, group, links): one row per text with its connected group (its least digest in hex) and the links of its class."""
        both = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy(F.col("a").alias("digest")).agg(F.count(F.lit(1)).alias("links"))
        known = components(self.links).join(degree, "digest", "full_outer")
        # Of classes without links nothing is known; a class of many equal texts learns it where its members are.
        sizes = self.members.groupBy("digest").agg(F.count(F.lit(1)).alias("size"))
        total = max(1, self.members.count())
        told = lookup_join(self.members, sizes.join(known, "digest", "left"), "digest", F.col("size") > F.lit(HOT_SHARE * total), "left")
        return told.select("key", F.hex(F.coalesce("label", "digest")).alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicates(df: DataFrame, key: str, columns: list[str], rules: tuple[tuple[str, str], ...], size: int = 5, threshold: float = 0.8, min_words: int = 0) -> NearDuplicates:
    """Texts whose sets of ``size`` consecutive words have a Jaccard similarity of at least ``threshold``.

    Rows repeated in a key count once. Null keys and texts with fewer words than ``min_words``
    or ``size`` are left out; null columns count as empty. Equal sets form one class and are
    compared once. Similarity is checked exactly; what the forest may miss is measured in the
    tests against all pairs.
    """
    spark = df.sparkSession
    with shuffles_dropped(spark):
        made = features(df, key, columns, size, min_words, rules).withColumn("part", part_of("digest"))
        path = stored(made, "features", by="part")
        texts = spark.read.schema(made.schema).parquet(path)
        members = written(texts.select("key", "digest").distinct(), "members")
        before = tables()
        found = stored(candidates(texts, threshold), "found")
        for done in tables() - before - {found}:
            discard(spark, done)
        found = spark.read.schema("a binary, b binary").parquet(found)
        kept = sets_of(texts, written(found.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "asked"), "sets", path)
        sets = spark.read.schema("digest binary, n int, hashes binary").parquet(kept)
        met = found.join(sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb")), "b")
        # Sets whose sizes alone rule the similarity out aren't sent to Python.
        met = met.filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
        checked = met.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(_shared, "a binary, b binary, na int, nb int, both int")
        links = written(checked.filter(F.col("both") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "links")
        for done in (path, kept):
            discard(spark, done)
    return NearDuplicates(members, links)


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(digest, label): the least member of each connected component, by alternating large and small stars.

    Each round is a few group-bys and joins over the links; a node of many links sends them
    to its least neighbour, so stars shrink and the number of rounds grows with the
    logarithm of the longest path. Rounds are written, so none is computed again.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    size = max(1, edges.count())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = F.col("_c") > F.lit(HOT_SHARE * size)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_c")).select("u", F.least("u", "m").alias("m"), "_c")
        # Large star: greater neighbours move to the least one.
        large = written(lookup_join(both, least, "u", hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        # Small star: smaller neighbours, and the node itself, move to the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_c"))
        moved = lookup_join(large, small_least, "u", hot)
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = written(small, "edges")
        size, before = max(1, new.count()), size
        same = size == before and not new.exceptAll(edges).limit(1).count()
        edges = new
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("digest"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("digest"), F.col("v").alias("label"))).groupBy("digest").agg(F.min("label").alias("label"))
