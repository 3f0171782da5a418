"""Helpers shared by the operators: text columns as flat buffers, words, rolling hashes, components."""

from __future__ import annotations

import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.runtime import durable

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(7))
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
U64 = np.uint64

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
CHUNK = 1 << 20


def doc_key(doc_id: Column, text: Column) -> Column:
    """The place of a document in ID order; without an ID, after all others and by the hash of its text."""
    unnamed = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(2**62)
    return F.coalesce(doc_id.cast("long"), unnamed)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the offsets of each; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges of about ``limit`` bytes."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def kept() -> dict:
    """What a worker process keeps from task to task.

    The code travels with each task, so the state of these modules does not
    stay; large tables in it would wait for the garbage collector.
    """
    return sys.modules.setdefault("_ledgerloom_kept", types.ModuleType("_ledgerloom_kept")).__dict__


def own(operator: str) -> dict:
    """What a worker process keeps from task to task for one operator.

    It goes when a task of another operator begins there, so that a stage of a
    pipeline does not carry the tables of the stages before; nor their powers.
    """
    state = kept()
    if state.get("operator") != operator:
        for table in state.pop("own", {}).values():
            table.close()
        state.pop("powers", None)
        state.update(operator=operator, own={})
        pa.default_memory_pool().release_unused()
    return state["own"]


def powers(count: int, base: int = _BASE) -> np.ndarray:
    tables = kept().setdefault("powers", {})
    have = tables.get(base)
    if have is None or len(have) < count:
        have = np.full(max(1 << 20, 1 << count.bit_length()), base, U64)
        have[0] = 1
        have = tables[base] = np.cumprod(have)
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), _BASE_INV)[start])


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (and in all)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = between[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[inner] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, or other span in ascending order, and the distinct ones by number."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` items, not yet mixed."""
    count = len(h) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    total, offset, span, current, left = np.zeros(count, U64), 0, 1, h, size
    while left:
        if left & 1:
            total += current[offset: offset + count] * powers(offset + 1)[offset]
            offset += span
        left >>= 1
        if left:
            current = current[:-span] + current[span:] * powers(span + 1)[span]
            span *= 2
    return total


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    count, span = len(x) - size + 1, 1
    if count <= 0:
        return x[:0]
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:count], x[size - span: size - span + count])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Positions of the keys that occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == keys)


def per_document(sums_of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 or integer array between offsets."""
    total = np.zeros(len(sums_of) + 1, np.int64)
    np.cumsum(sums_of, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Memory:
    """Number sequences of words, worked out once per worker and word.

    ``work`` maps new words to their sequences; it gets at most ``batch`` of them at once.
    """

    def __init__(self, work, most: int, batch: int | None = None):
        self.work, self.most, self.batch = work, most, batch
        self._forget()

    def close(self) -> None:
        """Lets go of the words and of their owner."""
        self._forget()
        self.work = None

    def _forget(self) -> None:
        self.index: dict = {}
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of all words, one after the other, and the length of each."""
        new = list(set(words).difference(self.index))
        if self.index and len(self.index) + len(new) > self.most:
            self._forget()
            new = list(set(words))
        if new:
            ids, lengths = [self.ids], []
            for at in range(0, len(new), self.batch or len(new)):
                found = self.work(new[at: at + (self.batch or len(new))])
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
            length = np.concatenate(lengths)
            start = len(self.ids) + np.cumsum(length) - length
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.ids, self.start, self.length = np.concatenate(ids), np.append(self.start, start), np.append(self.length, length)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        length = self.length[which]
        first = np.cumsum(length) - length
        return self.ids[np.repeat(self.start[which] - first, length) + np.arange(int(length.sum()))], length


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the smallest node that can be reached.

    Alternates two star contractions until nothing changes; every round is
    written to the shared folder, so a lost executor costs one round.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    star = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = smallest(large)
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        star = durable(small)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
