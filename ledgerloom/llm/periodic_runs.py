"""Periodic runs of words: stretches in which a short sequence of words is repeated four times or more.

A run is a stretch of words with smallest period q (words q apart are equal),
of at least ``max(6, 4 * q)`` words, that no neighbouring word extends. Runs
are found over the suffixes of a document. Suffix classes, the position sets
of suffixes with equal beginnings, are united by decreasing common prefix
(Kruskal's order) in a union-find whose sets are ordered by position. Two
positions that become neighbours in a set at depth l share exactly l words. If
their distance q is at most l / 3 and the words before them differ, they are
the first two periods of a run of q + l words. The smaller set always enters
the larger, so n positions meet n log n neighbours.

Only suffixes whose first five words recur in the document can lie in a run;
the others are left out before any sorting. Common prefixes are exact: words
are numbered by a dictionary of their bytes, and hashes only pick candidates.

Every document is worked out on its own, so there is no shuffle and no hot
key. A task's memory is bounded by its longest document, about 100 bytes for
each of its words.

Defined results: a null text is empty; an empty one has no words, no runs and
the hashes of empty strings. Equally good runs: the smallest start, then the
smallest period. Repeated rows stay and are worked out each. A document
without ID is never rewritten. Empty tables give no rows. Of further columns,
whatever their names, none is read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import common as C

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Two neighbouring positions of a run share at least so many words.
GRAM = LEAST - 1


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for the same word."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    letters = data[~C.SPACE[data]]
    column = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters))])
    return column.dictionary_encode().indices.to_numpy()


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group begins."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _firsts(new: np.ndarray) -> np.ndarray:
    """The index of the first member of each one's group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    """The suffixes that begin with ``GRAM`` words which recur in their document, sorted, with their common prefixes.

    The few suffixes after each such stretch are sorted with them, so that
    whatever follows a shared beginning has its place in the order.
    """

    def __init__(self, codes: np.ndarray, owner: np.ndarray, end: np.ndarray):
        self.codes, self.end = codes, end
        hashed = C.mix(codes.astype(np.uint64) + np.uint64(1))
        inside = np.flatnonzero(owner[: max(0, len(codes) - GRAM + 1)] == owner[GRAM - 1:])
        key = C.mix(C.mix(C.rolling(hashed, GRAM))[inside] + owner[inside].astype(np.uint64))
        near = np.zeros(len(codes) + GRAM + 1, bool)
        again = inside[C.repeated(key)]
        for i in range(GRAM + 1):
            near[again + i] |= owner[np.minimum(again + i, len(codes) - 1)] == owner[again]
        self.at = np.flatnonzero(near[: len(codes)])
        self.place = np.full(len(codes) + 1, -1, np.int64)
        self.place[self.at] = np.arange(len(self.at))
        self.owner = owner[self.at]
        self.ranks: list[np.ndarray] = []
        self._sort()

    def _sort(self) -> None:
        """Ranks by the first 5, 10, 20, ... words, until no two suffixes share one."""
        columns = [self.owner]
        for i in range(GRAM):
            inside = self.at + i < self.end[self.owner]
            columns.append(np.where(inside, self.codes[np.minimum(self.at + i, len(self.codes) - 1)], -1))
        order = np.lexsort(columns[::-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = _firsts(_changes(*(c[order] for c in columns)))
        span = GRAM
        self.ranks.append(rank)
        while True:
            shared = np.bincount(rank, minlength=len(rank))[rank] > 1
            active = np.flatnonzero(shared)
            if not len(active):
                return
            following = self._at(self.at[active] + span, self.owner[active])
            second = np.where(following >= 0, rank[following], -1)
            order = np.lexsort((second, rank[active]))
            active, second = active[order], second[order]
            old = rank[active]
            rank = rank.copy()
            rank[active] = old + _firsts(_changes(old, second)) - _firsts(_changes(old))
            span *= 2
            self.ranks.append(rank)

    def _at(self, position: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The suffix at a position, or -1: none there, or of another document."""
        return np.where(position < self.end[owner], self.place[np.minimum(position, len(self.codes))], -1)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in sorted order with their common prefix, in words."""
        order = np.argsort(self.ranks[-1])
        a, b = order[:-1], order[1:]
        same = self.ranks[0][a] == self.ranks[0][b]
        a, b = a[same], b[same]
        owner, x, y = self.owner[a], self.at[a].copy(), self.at[b].copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            i, j = self._at(x, owner), self._at(y, owner)
            rank = self.ranks[level]
            step = np.where((i >= 0) & (j >= 0) & (rank[i] == rank[j]), GRAM << level, 0)
            x += step
            y += step
        for _ in range(GRAM - 1):
            more = np.maximum(x, y) < self.end[owner]
            more[more] = self.codes[x[more]] == self.codes[y[more]]
            x += more
            y += more
        return a, b, x - self.at[a]


def seeds(position: list, a: list, b: list, depth: list) -> tuple[list, list, list]:
    """Start, period and common prefix of neighbours close enough for a run; edges come by falling depth."""
    parent = list(range(len(position)))
    sets = [[p] for p in position]
    starts, periods, depths = [], [], []
    most = PERIODS - 1

    def found(left, right, shared):
        if (right - left) * most <= shared:
            starts.append(left)
            periods.append(right - left)
            depths.append(shared)

    for x, y, shared in zip(a, b, depth):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small, last = sets[x], sets[y], None
        for number, p in enumerate(small):
            i = bisect_left(large, p)
            if i and large[i - 1] != last:
                found(large[i - 1], p, shared)
            if i < len(large) and not (number + 1 < len(small) and small[number + 1] < large[i]):
                found(p, large[i], shared)
            large.insert(i, p)
            last = p
        parent[y], sets[y] = x, None
    return starts, periods, depths


def runs_of(codes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of every run, in this order. ``before`` holds the words before each document."""
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    none = np.zeros(0, np.int64)
    if len(codes) < LEAST:
        return none, none, none, none
    suffixes = Suffixes(codes, owner, before[1:])
    if not len(suffixes.at):
        return none, none, none, none
    a, b, depth = suffixes.edges()
    order = np.argsort(-depth, kind="stable")
    found = seeds(suffixes.at.tolist(), *(x[order].tolist() for x in (a, b, depth)))
    start, period, shared = (np.array(x, np.int64) for x in found)
    doc = owner[start] if len(start) else none
    inner = start > before[doc] if len(start) else np.zeros(0, bool)
    longer = inner.copy()
    longer[inner] = codes[start[inner] - 1] == codes[start[inner] - 1 + period[inner]]
    doc, start, period, shared = (x[~longer] for x in (doc, start, period, shared))
    order = np.lexsort((period, start, doc))
    return doc[order], (start - before[doc])[order], (period + shared)[order], period[order]


def _sources(before: np.ndarray, rewrite) -> np.ndarray:
    """The original word that stands at each place; ``rewrite`` gives (document, first word, period) of changed ones."""
    source = np.arange(before[-1])
    for doc, first, period in rewrite:
        low, high = before[doc] + first, before[doc + 1]
        source[low:high] = low + np.arange(high - low) % period
    return source


def _worked(texts: pa.Array, hashes: pa.Array | None):
    """By step: number of documents, words before each, source of each word, (doc, start, length, period) of runs, byte texts."""
    data, offsets = C.flat(texts)
    h = None if hashes is None else hashes.to_pylist()
    for low, high in C.steps(offsets):
        piece, bounds = data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
        starts, ends, before = C.words(piece, bounds)
        counts = np.diff(before)
        rewrite = []
        for doc, n in enumerate(counts.tolist() if h is not None else ()):
            crc = h[low + doc]
            if crc is not None and crc % 10 == 0 and n:
                g = crc // 10
                rewrite.append((doc, g % n, 1 + (n - g % n) // (3 + g % 8)))
        source = _sources(before, rewrite)
        codes = numbered(piece, starts, ends)[source]
        raw = piece.tobytes()
        yield high - low, before, source, runs_of(codes, before), [raw[i:j] for i, j in zip(bounds[:-1], bounds[1:])]


def _kept(before, runs) -> np.ndarray:
    """Which words lie in no run beyond its first period."""
    doc, start, length, period = runs
    edge = np.zeros(int(before[-1]) + 1, np.int64)
    np.add.at(edge, before[doc] + start + period, 1)
    np.add.at(edge, before[doc] + start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def _collapsed(text: bytes, source: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words of one document joined by a blank; ``source`` counts from its first word."""
    parts = text.split()
    chosen = source[keep]
    if len(chosen) == len(parts) and (chosen == np.arange(len(parts))).all():
        return b" ".join(parts)
    return b" ".join([parts[i] for i in chosen.tolist()])


def _best(docs: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """(document, index of its run with most periods). Whole periods, then the rest of one, which a float holds exactly enough."""
    doc, start, length, period = runs
    order = np.lexsort((period, start, -((length % period) / np.maximum(period, 1)), -(length // np.maximum(period, 1)), doc))
    first = order[_changes(doc[order])] if len(order) else order
    return doc[first], first


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, low = batch.column("doc_id"), 0
        for docs, before, source, runs, texts in _worked(batch.column("text"), batch.column("crc")):
            doc, start, length, period = runs
            keep = _kept(before, runs)
            bounds = np.searchsorted(doc, np.arange(docs + 1))
            said = [f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist())]
            runs_sha = [hashlib.sha256("".join(said[i:j]).encode()).hexdigest() for i, j in zip(bounds[:-1], bounds[1:])]
            text_sha = [
                hashlib.sha256(_collapsed(t, source[i:j] - i, keep[i:j])).hexdigest()
                for t, i, j in zip(texts, before[:-1].tolist(), before[1:].tolist())]
            at, best = _best(docs, runs)
            mask = np.ones(docs, bool)
            mask[at] = False
            columns = []
            for values in (start, length, period, 1000 * length // np.maximum(period, 1)):
                column = np.zeros(docs, np.int64)
                column[at] = values[best]
                columns.append(pa.array(column, mask=mask))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, docs), pa.array(np.diff(bounds)), *columns, pa.array(runs_sha, pa.string()),
                 pa.array(text_sha, pa.string())], schema=_OUT)
            low += docs


def decimal_crc(doc_id: str) -> Column:
    """CRC-32 of an ID's decimal form."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its runs, the one with most periods, and what is left without repeats.

    Before that, a document whose ID's checksum is divisible by 10 has its
    tail rewritten as a repetition, as the query's contract says.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", decimal_crc("doc_id").alias("crc"))
    return slim.mapInArrow(
        _digests, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, low = batch.column("doc_id"), 0
        for docs, _, _, (doc, start, length, period), _ in _worked(batch.column("text"), None):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, docs).take(pa.array(doc)), *map(pa.array, (start, length, period))],
                names=["doc_id", "start", "length", "period"])
            low += docs


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length and period of every run of the texts as they are, in words from 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _listed, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each run cut to its first period; a text without a run stays as it is, every row stays."""
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low = batch.column("text").to_pylist(), 0
            for docs_, before, source, found, raw in _worked(batch.column("text"), None):
                keep = _kept(before, found)
                for i in np.unique(found[0]).tolist():
                    words = slice(before[i], before[i + 1])
                    texts[low + i] = _collapsed(raw[i], source[words] - before[i], keep[words]).decode()
                low += docs_
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column("text").type))

    return docs.mapInArrow(cut, schema)
