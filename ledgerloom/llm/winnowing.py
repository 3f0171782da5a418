"""Benchmark decontamination by winnowing.

Texts are words of ASCII letters (A-Z lower-cased), digits and all other
characters beyond ASCII. A window is ``SIZE`` consecutive words of an item; an
item of fewer words is one window. Of every window of t words the grams of
t - 2 words with the smallest hash are its fingerprints, so a document that
holds a window holds its fingerprints at the same places: every shared span of
t words is found, whatever stands around it. For items below ``SIZE`` words,
documents are winnowed at each length that occurs, at most ``SIZE`` of them.

1. Fingerprints of all items go into a bitmap of bounded size (``BITS``); it
   only saves work, fingerprints it lets through by chance match nothing later.
2. One pass over the documents winnows them. A fingerprint that the bitmap
   knows is extended to the windows around it, and their digests (SHA-256 of
   the words, 16 bytes) are kept beside the document's number of words.
3. These windows are joined with the items' windows on fingerprint and digest.
   An item window is one row however many items hold it, so neither copies of
   items nor copies of documents are ever paired. Windows stand for sets of
   items (a sum of hashes names a set), and documents with the same sets share
   one digest of item IDs, sorted and hashed once (``ordered``).

Defined results: null texts have no words and are not contaminated. Rows that
share an ID are judged each by its own text; rows of the benchmark that share
an ID are one item; an item without ID is named by the empty string. Ties:
all smallest grams of a window are fingerprints. Empty tables: no rows, or no
hits. Very long texts are steps of their own; a task holds about 100 bytes a
word of one. Further columns, whatever their names, are not read, and
``clean`` returns them unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import common as C, ordered
from ledgerloom.runtime import durable

SIZE = 10
#: Words by which a fingerprint is shorter than its window.
SLACK = 2
#: At most so many bits (2 MB) hold the items' fingerprints.
BITS = 24

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = _BETWEEN[128:] = False

_HIT = "struct<start:int,size:int,mark:long,name:binary>"
_HIT_TYPE = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("mark", pa.int64()), ("name", pa.binary())])
_ROWS = f"row long, id long, n_words long, hits array<{_HIT}>"


def _words(column: pa.Array):
    """Steps of documents: first row, rows, bytes in lower case, starts, ends, words before each, hash of each word."""
    data, offsets = C.flat(column)
    for low, high in C.steps(offsets):
        piece = C.LOWER[data[offsets[low]: offsets[high]]]
        starts, ends, before = C.words(piece, offsets[low: high + 1] - offsets[low], _BETWEEN)
        yield low, high, piece, starts, ends, before, C.span_hash(C.prefix(piece), starts, ends)


def marks(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing at ``size`` words: the hash of the fingerprint of each window, and which windows lie in one document.

    Where equal grams tie, their hash is the same, and so is the window's mark.
    """
    gram = max(1, size - SLACK)
    grams = C.mix(C.rolling(hashes, gram) + np.uint64(size))
    least = C.sliding_min(grams, size - gram + 1)
    return least, owner[: len(least)] == owner[len(hashes) - len(least):]


def _name(text: bytes, starts: list, ends: list, first: int, size: int) -> bytes:
    return hashlib.sha256(b" ".join([text[starts[i]: ends[i]] for i in range(first, first + size)])).digest()[:16]


def _bits(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a fingerprint in the bitmap."""
    mask = np.uint64((1 << BITS) - 1)
    return (mark & mask).astype(np.int64), (mark >> np.uint64(32) & mask).astype(np.int64)


def _windows(step, sizes: list[int], known: np.ndarray | None):
    """Document, start, size, fingerprint and name of windows; of those only whose fingerprint is ``known``."""
    _, _, piece, starts, ends, before, hashes = step
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    text, firsts, lasts = None, None, None
    for size in sizes:
        if len(hashes) < size:
            continue
        mark, inside = marks(hashes, owner, size)
        if known is not None:
            low, high = _bits(mark)
            inside &= (known[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)
            inside[inside] &= (known[high[inside] >> 3] >> (high[inside] & 7).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(inside)
        if len(at) and text is None:
            text, firsts, lasts = piece.tobytes(), starts.tolist(), ends.tolist()
        names = [_name(text, firsts, lasts, i, size) for i in at.tolist()]
        yield owner[at], at - before[owner[at]], np.full(len(at), size), C.signed(mark[at]), names


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in _words(batch.column("text")):
            count = np.diff(step[5])
            sizes = sorted({min(SIZE, n) for n in count.tolist() if n})
            for owner, _, size, mark, names in _windows(step, sizes, None):
                own = np.minimum(SIZE, count[owner]) == size
                keep = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(step[0] + owner[keep])), pa.array(size[keep].astype(np.int32)),
                     pa.array(mark[keep]), pa.array([names[i] for i in keep.tolist()], pa.binary())],
                    names=["item", "size", "mark", "name"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item, size, mark, name) of all windows of all items."""
    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return slim.mapInArrow(_item_rows, "item string, size int, mark long, name binary").distinct()


def bitmap(windows: DataFrame) -> bytes:
    """The fingerprints' bits: at most 2 ** ``BITS`` of them, however many items there are."""
    bit = lambda shift: F.shiftrightunsigned("mark", shift).bitwiseAND((1 << BITS) - 1) + 1
    parts = (
        windows.select("mark").distinct().select(F.explode(F.array(bit(0), bit(32))).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")))
    whole = bytearray(1 << BITS - 3)
    for row in parts.collect():
        at = (row["bucket"] - 1) * 4096
        whole[at: at + 4096] = row["bits"]
    return bytes(whole)


def _document_rows(sizes: list[int], known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, bits = TaskContext.get().partitionId() << 40, np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for step in _words(batch.column("text")):
                docs = step[1] - step[0]
                found = list(_windows(step, sizes, bits))
                owner = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                order = np.argsort(owner, kind="stable")
                values = [np.concatenate([f[i] for f in found])[order] if found else np.zeros(0, np.int64) for i in (1, 2, 3)]
                names = [name for f in found for name in f[4]]
                hits = pa.StructArray.from_arrays(
                    [pa.array(values[0].astype(np.int32)), pa.array(values[1].astype(np.int32)), pa.array(values[2].astype(np.int64)),
                     pa.array([names[i] for i in order.tolist()], pa.binary())], fields=list(_HIT_TYPE))
                bounds = np.searchsorted(owner[order], np.arange(docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + docs)), batch.column("id").slice(step[0], docs), pa.array(np.diff(step[5])),
                     pa.ListArray.from_arrays(pa.array(bounds), hits)], names=["row", "id", "n_words", "hits"])
                row += docs
    return run


def _covered(spans: Column) -> Column:
    """Words in at least one of the (start, size) of a sorted array."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(spans, start, lambda a, x: F.struct(
        (a["sum"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("sum"),
        F.greatest(a["end"], x["start"] + x["size"]).alias("end")))["sum"]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"))


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    windows = durable(item_windows(benchmark))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most SIZE of them
    known = spark.sparkContext.broadcast(bitmap(windows))
    rows = durable(docs.mapInArrow(_document_rows(sizes, known), _ROWS))
    hits = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")

    one, two = F.xxhash64("item").cast("decimal(38,0)"), F.xxhash64(F.lit(1), "item").cast("decimal(38,0)")
    named = durable(
        windows.groupBy("size", "mark", "name")
        .agg(F.count("*").alias("n"), F.sum(one).alias("one"), F.sum(two).alias("two"))
        .select("size", "mark", "name", F.sha2(F.concat_ws("|", "n", "one", "two"), 256).alias("items")))
    matched = (
        hits.join(named, ["size", "mark", "name"]).groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"),
             F.array_sort(F.collect_set("items")).alias("sets"))
        .select("row", _covered(F.col("spans")).cast("long").alias("n_hit"), "sets", F.sha2(F.concat_ws("|", "sets"), 256).alias("key")))
    matched = durable(matched)

    example = named.groupBy("items").agg(F.min(F.struct("size", "mark", "name")).alias("w")).select("items", "w.*")
    members = windows.join(example, ["size", "mark", "name"]).select("items", "item")
    wanted = matched.groupBy("key").agg(F.first("sets").alias("sets")).select("key", F.explode("sets").alias("items"))
    lists = ordered.digests(wanted.join(members, "items").select("key", F.col("item").alias("member")).distinct())
    judged = matched.select("row", "n_hit", "key").join(lists, "key", "left")
    return (
        rows.select("row", "id", "n_words").join(judged, "row", "left")
        .select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n", F.lit(0)).alias("n_items"),
                F.coalesce("sha", ordered.empty_digest()).alias("items_sha256")))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """``docs`` without those of which more than ``share`` of the words lie in a benchmark window.

    Judged by text, so that rows without ID or with a shared one are told apart.
    """
    key = F.xxhash64(F.lit(3), "text")
    bad = (
        _judged(docs.select(key.alias("id"), "text"), benchmark)
        .where(F.col("n_hit") > F.col("n_words") * share).select(F.col("id").alias("_ll_text")).distinct())
    return docs.join(bad, key == F.col("_ll_text"), "left_anti")
