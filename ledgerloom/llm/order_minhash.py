"""Order MinHash fingerprints, which follow the edit distance of texts.

The k-mers of a text (``K`` code points) are numbered by occurrence. Under each
of ``SKETCHES`` permutations the ``TUPLE`` smallest are taken, put back in text
order and hashed as a tuple; the likeness of two texts is the share of equal
tuples. Text that moves keeps its k-mers but not their order, so it counts.

``compare`` puts the documents in descending ID order and compares each with
the next one and with its own edited form. The rows are dealt to ranges of IDs
that follow the quantiles; the first row of each range is also sent to the
range before it, so every task reads on to its last document's successor.

Null or empty text has the fingerprint of no k-mer at all (zeros; two of them
are alike); a text shorter than a k-mer is one k-mer. Rows without an ID come
last; rows that share an ID follow each other in the order of their texts'
hashes. A single row is its own successor. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import common as C

K, SKETCHES, TUPLE = 8, 32, 2
_draw = np.random.Generator(np.random.PCG64(11))
_FACTOR = _draw.integers(1, 2**32, (SKETCHES, 1), dtype=np.uint32) | np.uint32(1)
_SHIFT = _draw.integers(0, 2**32, (SKETCHES, 1), dtype=np.uint32)
_NO_ID = -(2**63)


def fingerprint(text: str | None) -> np.ndarray:
    """The tuple hashes (32 bits each) of one text."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(SKETCHES, np.uint32)
    h = C.mix(C.rolling(C.mix(points.astype(np.uint64) + C.U64(1)), min(K, len(points))))
    x = (h >> C.U64(32)).astype(np.uint32)
    bits = C.U64(len(h).bit_length())
    ordered = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    same = np.flatnonzero(np.diff(ordered >> bits) == 0) + 1
    if len(same):  # occurrence numbers of repeated k-mers
        new = np.ones(len(ordered), bool)
        new[same] = False
        first = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
        number = (same - first[same]).astype(np.uint64)
        at = (ordered[same] & ((C.U64(1) << bits) - C.U64(1))).astype(np.int64)
        x[at] = (C.mix(h[at] + number * C.U64(0x9E3779B97F4A7C15)) >> C.U64(32)).astype(np.uint32)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 17) // len(x))
    for a in range(0, SKETCHES, step):
        ranks = (x ^ _SHIFT[a: a + step]) * _FACTOR[a: a + step]
        rows = np.arange(len(ranks))
        least = np.empty((len(ranks), min(TUPLE, len(x))), np.int64)
        for t in range(least.shape[1]):
            least[:, t] = ranks.argmin(1)
            ranks[rows, least[:, t]] = 0xFFFFFFFF
        least.sort(1)
        tuples = np.zeros(len(ranks), np.uint64)
        for t in range(least.shape[1]):
            tuples = C.mix((tuples << C.U64(1)) + x[least[:, t]])
        out[a: a + step] = tuples
    return (out >> C.U64(32)).astype(np.uint32)


def text_form(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _edited(text: str, successor: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + successor[:cut]


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [()] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    before = None  # range, ID, text and fingerprint of the row that waits for its successor
    for batch in batches:
        rows = []
        for home, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("home", "guest", "doc_id", "text"))):
            text = text or ""
            if before is None and guest:
                continue
            signature = fingerprint(text)
            if before is not None and before[0] == home:
                changed = _edited(before[2], text)
                other = fingerprint(changed)
                rows.append((before[1], len(before[2]), hashlib.sha256(changed.encode()).hexdigest(), text_form(before[3]),
                             text_form(other), likeness(before[3], other), likeness(before[3], signature)))
            before = None if guest else (home, doc_id, text, signature)
        yield batch_of(rows)


def _range_of(key: str, cuts: list[int]) -> str:
    """SQL for the number of cuts below or at the key, by halving."""
    def half(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {key} < {cuts[middle]} THEN {half(low, middle)} ELSE {half(middle + 1, high)} END"
    return half(0, len(cuts))


def compare(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints and likenesses of every row, see the module."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    ids = docs.select(key.alias("key"))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted({int(c) for c in ids.approxQuantile("key", steps, 1 / (8 * ranges))}) if steps else []
    home = F.expr(_range_of("_ll_key", cuts))
    # one row for each range, so as many as partitions
    heads = sorted(
        (r["home"], r["head"]) for r in
        ids.withColumnRenamed("key", "_ll_key").groupBy(home.alias("home")).agg(F.max("_ll_key").alias("head")).collect())
    if not heads:
        heads = [(0, 0)]
    guests = [(heads[i - 1][1], heads[i][0]) for i in range(1, len(heads))] + [(heads[-1][1], heads[0][0])]
    guests = spark.createDataFrame(guests, "_ll_head long, _ll_range int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("_ll_key"))
    guests = guests.groupBy("_ll_head").agg(F.collect_list("_ll_range").alias("_ll_ranges"))
    rows = rows.join(F.broadcast(guests), F.col("_ll_key") == F.col("_ll_head"), "left")
    dealt = rows.select(
        "doc_id", "text", "_ll_key",
        F.explode(F.concat(
            F.array(F.struct(home.alias("home"), F.lit(0).alias("guest"))),
            F.transform(F.coalesce("_ll_ranges", F.array().cast("array<int>")),
                        lambda r: F.struct(r.alias("home"), F.lit(1).alias("guest"))))).alias("place"))
    dealt = dealt.select("place.home", "place.guest", "doc_id", "text", "_ll_key")
    dealt = dealt.repartitionById(ranges, F.col("home")).sortWithinPartitions(
        "home", "guest", F.desc("_ll_key"), F.xxhash64("text"))
    return dealt.select("home", "guest", "doc_id", "text").mapInArrow(_compared, _SCHEMA)
