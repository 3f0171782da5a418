"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
goes, at all its places. Equal strings meet by their anchor, the smallest hash
of ``GRAM`` consecutive bytes in them: the strings of a document are cut into
stretches with one anchor, and the stretches are grouped by it. Stretches with
equal bytes repeat as a whole and need no further look; one of each kind goes,
with its text, to the shards. A shard sorts the suffixes of its stretches by
induced sorting, computes the permuted common prefixes and finds the strings
shared by differing stretches.

Equal stretches inside a chunk of the input are joined before the shuffle, so
a passage in any number of documents is one row per chunk. Groups of more than
``GROUP_BYTES`` leave the shards and are resolved by grouping the hashes of
their strings.

Null or empty text has no bytes. Rows that share an ID are one document: the
places found in one are removed in all of them, and equal places of them are
one place. Rows without an ID are documents by their text. Empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import common as C
from ledgerloom.runtime import durable

LENGTH, GRAM = 200, 32
#: Bytes of one shard, and of the largest group that a shard takes.
SHARD_BYTES, GROUP_BYTES = 2 << 20, 4 << 20


# --- suffix arrays -----------------------------------------------------------

def _ranks_within(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by value, and each ordered item's number among its equals."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    return order, np.arange(len(values)) - first


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from ordered leftmost-smaller ones; a bucket's entries move together."""
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    start = end - count
    array = np.full(len(text), -1, np.int32)
    order, rank = _ranks_within(text[seeds])
    seeds = seeds[order]
    seeded = np.bincount(text[seeds], minlength=size)
    array[(end - seeded)[text[seeds]] + rank] = seeds
    seed_start, head = end - seeded, start.copy()

    def place(source: np.ndarray, smaller: bool, edge: np.ndarray) -> None:
        before = source[source > 0] - 1
        before = before[small[before] == smaller]
        if len(before):
            letters = text[before]
            order, rank = _ranks_within(letters)
            letters = letters[order]
            array[edge[letters] - 1 - rank if smaller else edge[letters] + rank] = before[order]
            moved = np.bincount(letters, minlength=size)
            edge += -moved if smaller else moved

    used = np.flatnonzero(count)
    for b in used:
        low = start[b]
        while low < head[b]:
            high = head[b]
            place(array[low:high], False, head)
            low = high
        place(array[seed_start[b]: end[b]], False, head)
    tail = end.copy()
    array[0], tail[0] = len(text) - 1, 0
    for b in used[::-1]:
        high = end[b]
        while high > tail[b]:
            low = tail[b]
            place(array[low:high][::-1], True, tail)
            high = low
        place(array[start[b]: head[b]][::-1], True, tail)
    return array


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced text, whose alphabet is too large for buckets: ranks by doubling."""
    rank, span = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-span or None][: max(0, len(rank) - span)] = rank[span:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(rank) - 1 or span >= len(rank):
            return order
        span *= 2


def suffix_array(letters: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes of ``letters`` (0 <= letter < size) by induced sorting."""
    text = np.zeros(len(letters) + 1, np.int32)
    np.add(letters, 1, out=text[:-1], casting="unsafe")
    size += 1
    n = len(text)
    differs = text[1:] != text[:-1]
    following = np.where(differs, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    following = np.minimum.accumulate(following[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(text[1:] > text[:-1], False)[following]
    del differs, following
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) <= 1:
        return _induce(text, small, leftmost, size)[1:]
    first = _induce(text, small, leftmost, size)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = first[is_leftmost[first]]
    # name the leftmost-smaller substrings
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(C.mix(text.astype(np.uint64) * C.U64(2) + small) * C.powers(n), out=sums[1:])
    stop = np.append(leftmost[1:] + 1, n)
    digest = C.span_hash(sums, leftmost, stop) ^ C.mix((stop - leftmost).astype(np.uint64))
    del sums, stop, first, is_leftmost
    number = np.searchsorted(leftmost, ordered)
    digest = digest[number]
    names = np.zeros(len(leftmost), np.int64)
    names[number] = np.r_[0, np.cumsum(digest[1:] != digest[:-1])]
    del digest, number
    seeds = ordered if names.max() == len(leftmost) - 1 else leftmost[_doubled(names)]
    return _induce(text, small, seeds, size)[1:]


def common_prefixes(letters: np.ndarray, array: np.ndarray, open_: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each ``open_`` place in text order, letters shared with the suffix before it in the array, up to ``most``.

    Letters are compared eight at a time; ``most`` is a multiple of eight, and
    only whole eights count.
    """
    before = np.full(len(letters), -1, np.int32)
    before[array[1:]] = array[:-1]
    padded = np.append(letters.astype(np.uint8), np.zeros(most + 8, np.uint8))
    eight = np.ndarray(len(letters) + most, "<u8", padded.data, strides=(1,))  # the eight letters from each place on
    shared = np.zeros(len(letters), np.int16)
    at = np.flatnonzero(open_ & (before >= 0))
    at = at[open_[before[at]]]
    for depth in range(0, most, 8):
        at = at[eight[at + depth] == eight[before[at] + depth]]
        shared[at] = depth + 8
    return shared


# --- stretches ---------------------------------------------------------------

_STRETCHES = "anchor long, content long, doc long, start int, n int, folded boolean"


def _stretches(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    lengths = np.diff(offsets)
    count = np.maximum(lengths - LENGTH + 1, 0)
    grams = C.mix(C.rolling(C.BYTE[data], GRAM))
    low = C.U64(0xFFFFFFFF)  # upper half: order of the grams, lower half: their places
    at = np.arange(len(grams), dtype=np.uint64)
    left = C.sliding_min(grams & ~low | at, LENGTH - GRAM + 1)
    right = low - (C.sliding_min(grams & ~low | (low - at), LENGTH - GRAM + 1) & low)
    owner = np.repeat(np.arange(len(ids)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = offsets[:-1][owner] + start
    left, right = (left[place], right[place]) if len(place) else (np.zeros(0, np.uint64),) * 2
    left = left & low
    anchor = grams[left.astype(np.int64)]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(owner)))
    content = C.span_hash(C.prefix(data), place[cut], place[cut] + n + LENGTH - 1) ^ C.mix(n.astype(np.uint64))
    # a stretch with its anchor at two places may hold equal strings itself
    folded = left[cut] != right[cut + n - 1]
    anchor, doc, start = anchor[cut], ids[owner[cut]], start[cut]
    again = C.repeated(C.mix(anchor + C.mix(content)))
    order = again[np.lexsort((start[again], doc[again], content[again], anchor[again]))]
    later = np.zeros(len(order), bool)
    twin = np.zeros(len(order), bool)
    if len(order):
        later[1:] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
        twin[1:] = later[1:] & (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1])
    # of equal stretches the first goes on; where they stand at several places, all are settled
    keep = np.ones(len(anchor), bool)
    keep[order[later]] = False
    group = np.cumsum(~later) - 1 if len(order) else np.zeros(0, np.int64)
    several = (np.bincount(group, later & ~twin) > 0)[group] if len(order) else np.zeros(0, bool)
    done = order[several & ~twin]
    settled = np.zeros(len(done), bool)
    at = np.append(np.flatnonzero(keep), done)
    blank = np.append(np.zeros(keep.sum(), bool), ~settled)
    spread = np.append(anchor[keep], C.mix(doc[done].astype(np.uint64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(C.signed(spread)), pa.array(C.signed(content[at]), mask=blank), pa.array(doc[at]),
         pa.array(start[at].astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(folded[at])],
        names=["anchor", "content", "doc", "start", "n", "folded"])


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        ids = batch.column("doc").to_numpy()
        for a, b in C.steps(offsets, 2 * C.CHUNK):
            yield _stretches(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], ids[a:b])


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each stretch asked for."""
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        raw, rows = data.tobytes(), []
        for i, asked in enumerate(batch.column("asked").to_pylist()):
            base, stop = int(offsets[i]), int(offsets[i + 1])
            for ask in asked:
                low = base + ask["start"]
                rows.append((ask["anchor"], batch.column("doc")[i].as_py(), ask["start"], ask["n"],
                             raw[low: min(low + ask["n"] + LENGTH - 1, stop)]))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "doc", "start", "n", "bytes"])


def _spans(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of starting places as spans."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(start) > 1)]) if len(doc) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[cut]), pa.array(start[cut].astype(np.int32)), pa.array((start[last] - start[cut] + 1).astype(np.int32)),
         pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.binary())], names=["doc", "start", "n", "anchor", "bytes"])


def _shard(docs: list[int], starts: list[int], texts: list[bytes]) -> pa.RecordBatch:
    """Starting places of strings that the stretches of a shard share."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    first = np.cumsum(size + 1) - size - 1
    letters = raw.astype(np.uint16) + np.uint16(1)
    letters[first + size] = 0
    edge = np.zeros(len(raw) + 1, np.int8)
    whole = size >= LENGTH
    edge[first[whole]] += 1
    edge[(first + size - LENGTH + 1)[whole]] -= 1
    open_ = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    array = suffix_array(letters, 257)
    shared = common_prefixes(raw, array, open_, LENGTH)[array] >= LENGTH
    # of the order only suffixes that share a string with a neighbour are looked at further
    again = shared.copy()
    again[:-1] |= shared[1:]
    at, group = array[again], np.flatnonzero(~shared[again])
    if not len(at):
        return _spans(np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner = np.searchsorted(first, at, "right") - 1
    doc, start = np.array(docs, np.int64)[owner], np.array(starts, np.int64)[owner] + at - first[owner]
    place = C.mix(C.mix(doc.astype(np.uint64)) + start.astype(np.uint64))
    differing = np.minimum.reduceat(place, group) != np.maximum.reduceat(place, group)
    hit = np.repeat(differing, np.diff(np.append(group, len(at))))
    return _spans(doc[hit], start[hit])


def _sorter(group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # rows of whole groups, then those of the group being read
        total, group_start, group_total, anchor, hot = 0, 0, 0, None, False

        def resolve(rows):
            return _shard([r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows])

        def leave(rows):
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()),
                 pa.array(c[0], pa.int64()), pa.array(c[4], pa.binary())], names=["doc", "start", "n", "anchor", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "start", "n", "bytes"))):
                if row[0] != anchor:
                    if total >= SHARD_BYTES:
                        yield resolve(waiting)
                        waiting, total = [], 0
                    anchor, group_start, group_total, hot = row[0], len(waiting), 0, False
                if hot:
                    yield leave([row])
                    continue
                waiting.append(row)
                total, group_total = total + len(row[4]), group_total + len(row[4])
                if group_total > group_bytes:
                    yield leave(waiting[group_start:])
                    total -= group_total
                    del waiting[group_start:]
                    hot = True
        if waiting:
            yield resolve(waiting)
    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all strings of stretches that no shard takes."""
    for batch in batches:
        data, offsets = C.flat(batch.column("bytes"))
        count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = offsets[:-1][owner] + inside
        key = C.span_hash(C.prefix(data), place, place + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("anchor").to_numpy()[owner]), pa.array(C.signed(key)),
             pa.array(batch.column("doc").to_numpy()[owner]),
             pa.array((batch.column("start").to_numpy()[owner] + inside).astype(np.int32))],
            names=["anchor", "key", "doc", "start"])


def spans(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc, start, n: strings at ``n`` consecutive places from byte ``start`` on that stand elsewhere too."""
    keyed = docs.select(C.doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    rows = keyed.mapInArrow(_cut_up, _STRETCHES)
    ordered = Window.partitionBy("anchor").orderBy("content", "doc", "start")
    whole = Window.partitionBy("anchor")
    other = lambda step: F.coalesce(
        (step("content").over(ordered) == F.col("content"))
        & ((step("doc").over(ordered) != F.col("doc")) | (step("start").over(ordered) != F.col("start"))), F.lit(False))
    first = F.coalesce(F.lag("content").over(ordered) != F.col("content"), F.lit(True)) & F.col("content").isNotNull()
    found = rows.select(
        "anchor", "doc", "start", "n", (F.col("content").isNull() | other(F.lag) | other(F.lead)).alias("settled"),
        (first & (F.col("folded") | (F.min("content").over(whole) != F.max("content").over(whole)))).alias("ask"))
    found = durable(found.where("settled or ask"))
    asked = found.where("ask").groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("asked"))
    text = keyed.join(asked, "doc").select("doc", "text", "asked").mapInArrow(
        _with_text, "anchor long, doc long, start int, n int, bytes binary")
    shards = text.repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    shards = durable(shards.mapInArrow(_sorter(group_bytes), "doc long, start int, n int, anchor long, bytes binary"))
    result = found.where("settled").select("doc", "start", "n").unionByName(
        shards.where("bytes is null").select("doc", "start", "n"))
    hot = shards.where("bytes is not null")
    if hot.isEmpty():
        return result
    strings = hot.mapInArrow(_strings, "anchor long, key long, doc long, start int").distinct()
    twice = strings.groupBy("anchor", "key").agg(F.count("*").alias("many")).where("many > 1")
    more = strings.join(twice, ["anchor", "key"])
    return result.unionByName(more.select("doc", "start", F.lit(1).alias("n")))


def _merge(found) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not found:
        return []
    start = np.array([s["start"] for s in found], np.int64)
    end = start + np.array([s["n"] for s in found], np.int64) + LENGTH - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[cut].tolist(), end[np.append(cut[1:], len(end)) - 1].tolist()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("found").to_pylist()):
            text, at, removed = text or b"", 0, 0
            runs, digest = _merge(found), hashlib.sha256()
            for low, high in runs:
                digest.update(text[at:low])
                removed, at = removed + min(high, len(text)) - low, high
            digest.update(text[at:])
            rows.append((len(text), removed, len(runs), digest.hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()]))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    by_doc = spans(docs, group_bytes).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", C.doc_key(F.col("doc_id"), F.col("text")).alias("doc"))
    return keyed.join(by_doc, "doc", "left").select("doc_id", "text", "found").mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
