"""All queries of a batch against groups of neighbouring documents, in arrays.

The plan of a batch is on the driver and goes to every executor. Postings of the asked terms
are shuffled once, as one number each, by groups of at most 65,536 documents. Within
a group, terms that many documents hold (dense ones) are arrays over its documents; what
several queries ask of them is done once for all queries with the same dense terms. The other
terms (sparse ones) are lists, which all queries meet at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import bm25
from textloom.operators.index import Index

#: Documents of a group: between 2**10 and 2**16.
GROUP_BITS = (10, 16)
#: A term is dense if at least one document in so many holds it.
DENSE = 64
#: Queries whose sparse lists are met at once.
AT_ONCE = 2048
#: A posting as one number: term, place within the group (16 bits), frequency (larger ones count as the largest).
TF_BITS = 27
PLACE_SHIFT, TERM_SHIFT = TF_BITS, TF_BITS + 16
MOST_TERMS = 1 << (63 - TERM_SHIFT)


@dataclass(frozen=True)
class Batch:
    """A plan in arrays. Terms have numbers in ascending order; queries are ordered by their dense terms.

    ``names``: query ids; ``every``, ``dense``, ``sparse``: (first row of each query, term numbers ascending); ``alike``: the
    first query of each run of queries with the same dense terms, and the number of queries.
    """

    names: list
    id_type: str
    words: list[str]
    df: np.ndarray
    idf: np.ndarray
    bound: np.ndarray
    average: float
    bits: int
    every: tuple[np.ndarray, np.ndarray]
    dense: tuple[np.ndarray, np.ndarray]
    sparse: tuple[np.ndarray, np.ndarray]
    alike: np.ndarray


def batch(index: Index, plan: DataFrame, most: int) -> Batch | None:
    """The batch of a plan; None if the plan has more than ``most`` rows or terms than have a number."""
    rows = plan.select("query_id", "term", "df", "idf", "bound", "average").limit(most + 1).toPandas()
    if len(rows) > most:
        return None
    first = rows.drop_duplicates("term")
    first = first.iloc[np.argsort(np.array([t.encode() for t in first["term"]], object), kind="stable")]
    if len(first) >= MOST_TERMS:
        return None
    words = first["term"].tolist()
    df = first["df"].to_numpy(np.int64)
    spark = index.documents.sparkSession
    facts = index.documents.agg(F.max("doc_id").alias("m"), F.count(F.lit(1)).alias("n")).first()
    wanted = max(1, ((facts.m or 0) + 1) // (4 * spark.sparkContext.defaultParallelism))
    bits = min(max(wanted.bit_length() - 1, GROUP_BITS[0]), GROUP_BITS[1])
    codes, names = pd.factorize(rows["query_id"])
    names = names.tolist()
    number = rows["term"].map({t: i for i, t in enumerate(words)}).to_numpy(np.int64)
    order = np.lexsort((number, codes))
    codes, number = codes[order], number[order]
    thick = df[number] * DENSE >= facts.n
    held: list[list[int]] = [[] for _ in names]
    for q, t in zip(codes[thick].tolist(), number[thick].tolist(), strict=True):
        held[q].append(t)
    by = sorted(range(len(names)), key=held.__getitem__)
    place = np.empty(len(names), np.int64)
    place[by] = np.arange(len(names))
    codes = place[codes]
    order = np.lexsort((number, codes))
    codes, number, thick = codes[order], number[order], thick[order]
    cut = lambda keep: (np.append(0, np.cumsum(np.bincount(codes[keep], minlength=len(names)))), number[keep])
    alike = [i for i, q in enumerate(by) if not i or held[q] != held[by[i - 1]]]
    average = float(first["average"].iloc[0]) if len(first) else 0.0
    return Batch([names[i] for i in by], plan.schema["query_id"].dataType.simpleString(), words, df, first["idf"].to_numpy(float), first["bound"].to_numpy(float), average, bits, cut(np.ones(len(codes), bool)), cut(thick), cut(~thick), np.array([*alike, len(names)], np.int64))


def postings(index: Index, b: Batch, *extra: str) -> DataFrame:
    """(g, x, ...) of the postings of a batch's terms: the group, the posting as one number, columns beside it."""
    asked = index.documents.sparkSession.createDataFrame(list(enumerate(b.words)), "number long, term string")
    met = index.postings.join(F.broadcast(asked), "term")
    tf = F.least(F.col("tf"), F.lit((1 << TF_BITS) - 1))
    place = F.col("doc_id").bitwiseAND(F.lit((1 << b.bits) - 1))
    x = F.shiftleft("number", TERM_SHIFT).bitwiseOR(F.shiftleft(place, PLACE_SHIFT)).bitwiseOR(tf)
    return met.select(F.shiftright("doc_id", b.bits).alias("g"), x.alias("x"), *extra)


def named(df: DataFrame, b: Batch) -> DataFrame:
    """Rows with the numbers of queries in ``q`` get their ids."""
    ids = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(b.names)], f"q long, query_id {b.id_type}")
    return df.join(F.broadcast(ids), "q").drop("q")


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


class Group:
    """The postings of one group, sorted by term and document; ``start`` has where each term's begin."""

    def __init__(self, b: Batch, x: np.ndarray) -> None:
        self.b, self.size = b, 1 << b.bits
        self.number = x >> TERM_SHIFT
        self.place = (x >> PLACE_SHIFT) & 0xFFFF
        self.tf = x & ((1 << TF_BITS) - 1)
        self.start = np.searchsorted(self.number, np.arange(len(b.words) + 1))

    def of(self, term: int) -> slice:
        return slice(self.start[term], self.start[term + 1])

    def met(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, posting) of the sparse lists of the queries from ``low`` to ``high``, by query and term."""
        first, terms = self.b.sparse
        rows = terms[first[low] : first[high]]
        begin, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        query = np.repeat(np.arange(low, high), np.diff(first[low : high + 1]))
        at = ranges(begin, size)
        return np.repeat(query, size), self.place[at], at

    def runs(self) -> Iterator[tuple[int, int, int, int]]:
        """(first, end) of a part of the queries, and (first, end) of the runs of equal dense terms within it."""
        alike = self.b.alike
        i = 0
        while i < len(alike) - 1:
            j = max(i + 1, int(np.searchsorted(alike, alike[i] + AT_ONCE, "right")) - 1)
            yield int(alike[i]), int(alike[j]), i, j
            i = j

    def terms_of(self, run: int) -> np.ndarray:
        first, terms = self.b.dense
        q = self.b.alike[run]
        return terms[first[q] : first[q + 1]]


def unions(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """(query, documents of the group that hold any of its terms)."""
    b = group.b
    bit = {}
    for t in np.unique(b.dense[1]).tolist():
        flags = np.zeros(group.size, bool)
        flags[group.place[group.of(t)]] = True
        bit[t] = np.packbits(flags, bitorder="little").view(np.uint64)
    none = np.zeros(group.size // 64, np.uint64)
    count = np.zeros(len(b.names), np.int64)
    for low, high, i, j in group.runs():
        held = np.stack([np.bitwise_or.reduce([none, *(bit[t] for t in group.terms_of(r).tolist())]) for r in range(i, j)])
        of_run = np.repeat(np.arange(j - i), np.diff(b.alike[i : j + 1]))
        count[low:high] = np.bitwise_count(held).sum(1, dtype=np.int64)[of_run]
        query, place, _ = group.met(low, high)
        keys = np.unique(query << 16 | place)
        query, place = keys >> 16, keys & 0xFFFF
        there = (held[of_run[query - low], place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        count += np.bincount(query[there == 0], minlength=len(count))
    return np.arange(len(count)), count


def _vbytes(v: np.ndarray) -> np.ndarray:
    return 1 + sum((v >= 1 << (7 * i)).astype(np.int64) for i in range(1, 5))


def list_sizes(group: Group, g: int, block: int) -> dict[str, list]:
    """Of each term's list in the group, what its payload bytes follow from, wherever its blocks begin.

    n, first and last document; ``inner``: bytes of all gaps but the first and of all frequencies; ``starts[i]``:
    what the i-th, i + block-th, ... posting take more if a block begins there.
    """
    n = np.diff(group.start)
    terms = np.flatnonzero(n)
    begin, n = group.start[terms], n[terms]
    doc = group.place + g * group.size
    gap = np.zeros(len(doc), np.int64)
    gap[1:] = np.diff(doc)
    gap[begin] = 0
    size = _vbytes(gap)
    size[begin] = 0
    inner = np.add.reduceat(size + _vbytes(group.tf), begin)
    more = _vbytes(doc) - size
    more[begin] = 0
    width = np.minimum(n, block)
    ends = np.cumsum(width)
    owner = np.repeat(np.arange(len(terms)), n)
    rank = np.arange(len(doc)) - begin[owner]
    starts = np.bincount((ends - width)[owner] + rank % block, weights=more, minlength=int(ends[-1])).astype(np.int64)
    return {"number": terms, "n": n, "first": doc[begin], "last": doc[begin + n - 1], "inner": inner, "starts": (np.append(0, ends), starts)}


def over_groups(index: Index, b: Batch, work: Callable, schema: str, *extra: str) -> DataFrame:
    """The rows that ``work(group number, sorted group, order, table)`` gives for each group."""
    return postings(index, b, *extra).groupBy("g").applyInArrow(_runner(b, work), schema)


def _runner(b: Batch, work: Callable) -> Callable:
    def run(table):
        x = np.asarray(table.column("x"))
        if table.num_columns == 2:
            return work(int(table.column("g")[0].as_py()), Group(b, np.sort(x)), None, table)
        order = np.argsort(x)
        return work(int(table.column("g")[0].as_py()), Group(b, x[order]), order, table)

    return run


# --- the best documents of every query ----------------------------------------------

#: Room for sums in another order: thresholds are lowered by this share.
ROOM = 1e-9


def _parts(group: Group, c: np.ndarray, low_q: int = 0, high_q: int | None = None) -> Iterator[tuple]:
    """(first, end of some queries, query, place and sum of their sparse lists by query and place, where each query's begin, runs).

    ``runs`` gives (run, sums of the dense terms over all documents of the group); the sums are added in ascending
    order of the terms, and those of common first terms are shared. They are valid until the next run.
    """
    b = group.b
    stack: list[tuple[int, np.ndarray]] = []
    nothing = np.zeros(group.size)

    def runs(i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
        for r in range(i, j):
            terms = group.terms_of(r).tolist()
            same = 0
            while same < min(len(stack), len(terms)) and stack[same][0] == terms[same]:
                same += 1
            del stack[same:]
            for t in terms[same:]:
                total = stack[-1][1].copy() if stack else nothing.copy()
                at = group.of(t)
                total[group.place[at]] += c[at]
                stack.append((t, total))
            yield r, stack[-1][1] if stack else nothing

    for low, high, i, j in group.runs():
        if high <= low_q or high_q is not None and low >= high_q:
            continue
        query, place, at = group.met(low, high)
        keys, of = np.unique(query << 16 | place, return_inverse=True)
        sums = np.bincount(of, weights=c[at], minlength=len(keys))
        query, place = keys >> 16, keys & 0xFFFF
        yield low, high, query, place, sums, np.searchsorted(query, np.arange(low, high + 1)), runs(i, j)


def scores_at(group: Group, c: np.ndarray, query: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The scores of documents for queries, summed in ascending order of all their terms."""
    first, terms = group.b.every
    size = first[query + 1] - first[query]
    owner = np.repeat(np.arange(len(query)), size)
    keys = group.number << 16 | group.place
    wanted = terms[ranges(first[query], size)] << 16 | place[owner]
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    held = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return np.bincount(owner[held], weights=c[at[held]], minlength=len(query))


def _ranks(k: int) -> np.ndarray:
    """1, 2, 3 ... k, in steps that grow by a tenth."""
    out = [1]
    while out[-1] < k:
        out.append(min(k, max(out[-1] + 1, int(out[-1] * 1.1))))
    return np.array(out)


def group_tops(group: Group, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, where each one's scores begin, scores): lower bounds of the scores at some ranks of each query in this group."""
    b, ranks = group.b, _ranks(k)
    queries: list[int] = []
    found: list[np.ndarray] = []
    taken = np.zeros(group.size, bool)
    for low, _, _, place, sums, begin, runs in _parts(group, c):
        for r, total in runs:
            top = np.flatnonzero(total)
            value = total[top]
            if len(top) > k:
                keep = value >= np.partition(value, len(value) - k)[len(value) - k]
                top, value = top[keep], value[keep]
            order = np.argsort(-value)
            top, value = top[order][:k], value[order][:k]
            shared = value[ranks[ranks <= len(value)] - 1]
            for q in range(int(b.alike[r]), int(b.alike[r + 1])):
                a, e = begin[q - low], begin[q - low + 1]
                own = shared
                if a < e:
                    at = place[a:e]
                    taken[at] = True
                    both = np.concatenate([value[~taken[top]], total[at] + sums[a:e]])
                    taken[at] = False
                    both = np.sort(both)[: -k - 1 : -1]
                    own = both[ranks[ranks <= len(both)] - 1]
                if len(own):
                    queries.append(q)
                    found.append(own)
    sizes = [len(x) for x in found]
    return np.array(queries, np.int64), np.append(0, np.cumsum(sizes, dtype=np.int64)), np.concatenate(found) * (1.0 - ROOM) if found else np.zeros(0)


def group_best(group: Group, c: np.ndarray, k: int, theta: np.ndarray, margin: float, low_q: int, high_q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the documents that reach the threshold of their query, for the queries from ``low_q`` to ``high_q``."""
    b = group.b
    least = theta * (1.0 - ROOM) - margin
    queries: list[np.ndarray] = []
    places: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    taken = np.zeros(group.size, bool)
    for low, _, query, place, sums, begin, runs in _parts(group, c, low_q, high_q):
        near = np.zeros(len(place))
        for r, total in runs:
            first, end = int(b.alike[r]), int(b.alike[r + 1])
            at = np.flatnonzero(total >= max(least[first:end].min(), 5e-324))
            value = total[at]
            for q in range(max(first, low_q), min(end, high_q)):
                a, e = begin[q - low], begin[q - low + 1]
                keep = value >= least[q]
                if a < e:
                    near[a:e] = total[place[a:e]] + sums[a:e]
                    taken[place[a:e]] = True
                    keep &= ~taken[at]
                    taken[place[a:e]] = False
                if keep.any():
                    places.append(at[keep])
                    scores.append(value[keep])
                    queries.append(np.full(len(places[-1]), q))
        keep = (near >= least[query]) & (query >= low_q) & (query < high_q)
        if keep.any():
            queries.append(query[keep])
            places.append(place[keep])
            scores.append(scores_at(group, c, query[keep], place[keep]))
    if not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, place, score = np.concatenate(queries), np.concatenate(places), np.concatenate(scores)
    # Of a query's documents with the very same score, only the k first can be among its best.
    order = np.lexsort((place, score, query))
    query, place, score = query[order], place[order], score[order]
    head = np.append(True, (query[1:] != query[:-1]) | (score[1:] != score[:-1]))
    keep = np.arange(len(query)) - np.flatnonzero(head)[np.cumsum(head) - 1] < k
    return query[keep], place[keep], score[keep]


def _contributed(group: Group, order: np.ndarray, table) -> np.ndarray:
    """What each posting adds to scores; the order of operations is that of :func:`bm25.score`."""
    tf = group.tf.astype(float)
    length = np.asarray(table.column("length"))[order]
    norm = (1.0 - bm25.B) + bm25.B * (length / group.b.average)
    return group.b.idf[group.number] * ((tf * (bm25.K1 + 1.0)) / (tf + bm25.K1 * norm))


def thresholds(index: Index, b: Batch, k: int) -> np.ndarray:
    """A score for each query that at least k documents reach; -1 where fewer are found."""
    import pyarrow as pa

    steps = np.diff(np.append(0, _ranks(k)))

    def tops(g: int, group: Group, order: np.ndarray, table):
        query, ends, score = group_tops(group, _contributed(group, order, table), k)
        return pa.table({"block": pa.array(query >> 10), "q": pa.array(query), "s": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(score))})

    def reached(table):
        lists = table.column("s").combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        query = np.repeat(np.asarray(table.column("q")), size)
        score = np.asarray(lists.flatten())
        weight = steps[ranges(np.zeros(len(size), np.int64), size)]
        order = np.lexsort((-score, query))
        query, score, weight = query[order], score[order], weight[order]
        head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        many = np.cumsum(weight)
        many = many - np.repeat(many[head] - weight[head], np.diff(np.append(head, len(query))))
        enough = np.flatnonzero(many >= k)
        first = enough[np.append(True, query[enough][1:] != query[enough][:-1])] if len(enough) else enough
        return pa.table({"q": pa.array(query[first]), "theta": pa.array(score[first])})

    rows = over_groups(index, b, tops, "block long, q long, s array<double>", "length").groupBy("block").applyInArrow(reached, "q long, theta double").toPandas()
    theta = np.full(len(b.names), -1.0)
    theta[rows["q"].to_numpy(np.int64)] = rows["theta"].to_numpy(float)
    return theta


def best(index: Index, b: Batch, k: int, theta: np.ndarray, digits: int | None, low: int, high: int) -> DataFrame:
    """(query_id, doc_id, score) with at least the k best documents of each query from ``low`` to ``high``."""
    import pyarrow as pa

    margin = 0.0 if digits is None else 2.0 * 10.0**-digits

    def run(g: int, group: Group, order: np.ndarray, table):
        query, place, score = group_best(group, _contributed(group, order, table), k, theta, margin, low, high)
        return pa.table({"q": pa.array(query), "doc_id": pa.array(place + g * group.size), "score": pa.array(score)})

    return named(over_groups(index, b, run, "q long, doc_id long, score double", "length"), b).select("query_id", "doc_id", "score")


def group_reaching(group: Group, c: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The number of documents of the group whose sums for a query are at least ``least`` of the query."""
    b = group.b
    count = np.zeros(len(b.names), np.int64)
    for low, _, query, place, sums, begin, runs in _parts(group, c):
        more = np.zeros(len(place), np.int64)
        for r, total in runs:
            for q in range(int(b.alike[r]), int(b.alike[r + 1])):
                a, e = begin[q - low], begin[q - low + 1]
                count[q] = np.count_nonzero(total >= least[q])
                if a < e:
                    alone = total[place[a:e]]
                    more[a:e] = (alone + sums[a:e] >= least[q]).astype(np.int64) - (alone >= least[q])
        count += np.bincount(query, weights=more, minlength=len(count)).astype(np.int64)
    return count
