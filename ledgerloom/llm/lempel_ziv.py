"""Removal of repeated passages by relative Lempel-Ziv parsing.

The reference of the parse is the corpus itself, indexed in blocks: an anchor,
the smallest hash of a few consecutive words among those in a window, names
the block in which a window is looked up, so equal windows meet in one block
wherever they stand. A block holds each differing window once, with the place
where it stands first. Documents are factored against it in ascending order:
a factor starts at a window that stands earlier and is extended along that one
place as long as the following windows follow there too, so no factor is
shorter than a window. As a window has one place in its block, the longest
factor is the only one and the greedy parse needs no choice. Factors end
where the reference ends, at another reference, or at the border of a block;
factors that touch or overlap become one span of repeated words.

Windows repeated inside a chunk of the input are settled before the shuffle,
so a passage shared by any number of documents reaches its block once per
chunk. Blocks with more than ``SEEN`` differing windows leave the first pass
and are resolved by a grouping on the windows themselves.

Null or empty text has no words. IDs are in ascending order, rows without ID
come last and are ordered by the hash of their text; rows that share an ID
are one document (what is removed in one of them is removed at the same
places of the others). Empty tables give no rows; further columns pass
through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import common as C
from ledgerloom.runtime import durable

#: Words of a window and of an anchor; bytes kept of a window's hash inside its block.
WINDOW, GRAM, TAG = 20, 6, 6
#: Differing windows that one block keeps in memory.
SEEN = 2_000_000

_ROWS = "anchor long, doc long, start int, n int, tags binary, ref long, ref_start int"
_SPANS = "kind int, doc long, start int, n int, ref long, ref_start int, anchor long, tag long"


def _runs(doc: np.ndarray, start: np.ndarray, *same: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
    """First positions of runs of consecutive windows of one document, equal in ``same`` and consecutive in ``follows``."""
    new = (np.diff(doc) != 0) | (np.diff(start) != 1)
    for column in same:
        new |= np.diff(column) != 0
    if follows is not None:
        new |= np.diff(follows) != 1
    return np.flatnonzero(np.r_[True, new]) if len(doc) else np.zeros(0, np.int64)


def _heads(later: np.ndarray) -> np.ndarray:
    """For each row the row that its group of equal keys begins with; ``later`` is false where a group begins."""
    return np.maximum.accumulate(np.where(later, 0, np.arange(len(later)))) if len(later) else np.zeros(0, np.int64)


def _windows(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts, ends, before = C.words(data, offsets)
    if len(starts) < WINDOW:
        return
    h = C.span_hash(C.prefix(data), starts, ends)
    owner = np.repeat(np.arange(len(ids)), np.diff(before))
    window = C.mix(C.rolling(h, WINDOW))
    anchor = C.sliding_min(C.mix(C.rolling(h, GRAM)), WINDOW - GRAM + 1)
    open_ = owner[: len(window)] == owner[WINDOW - 1:]
    at = np.flatnonzero(open_)
    again = at[C.repeated(window[at])]
    doc, start = ids[owner[again]], again - before[owner[again]]
    order = np.lexsort((start, doc, window[again]))
    again, doc, start = again[order], doc[order], start[order]
    later = np.r_[False, window[again][1:] == window[again][:-1]] if len(again) else np.zeros(0, bool)
    # the same place of two rows of one ID is one occurrence
    same = np.r_[False, (np.diff(doc) == 0) & (np.diff(start) == 0)] & later if len(again) else later
    open_[again[later]] = False
    ref, ref_start = (x[_heads(later)] for x in (doc, start))
    gone = again[later & ~same]
    order = np.argsort(gone)
    gone, ref, ref_start = gone[order], ref[later & ~same][order], ref_start[later & ~same][order]
    doc, start = ids[owner[gone]], gone - before[owner[gone]]
    first = _runs(doc, start, owner[gone], ref, follows=ref_start)
    n = np.diff(np.append(first, len(gone)))
    at = np.flatnonzero(open_)
    doc_at, start_at, anchor_at = ids[owner[at]], at - before[owner[at]], anchor[at]
    cut = _runs(doc_at, start_at, anchor_at)
    tags = np.ascontiguousarray(window[at].view(np.uint8).reshape(-1, 8)[:, :TAG])
    bounds = np.append(cut, len(at)) * TAG
    blob = pa.Array.from_buffers(
        pa.binary(), len(cut), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(tags.tobytes())])
    names = ["anchor", "doc", "start", "n", "tags", "ref", "ref_start"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(C.signed(anchor_at[cut])), pa.array(doc_at[cut]), pa.array(start_at[cut].astype(np.int32)),
         pa.array(np.diff(np.append(cut, len(at))).astype(np.int32)), blob, pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int32())],
        names=names)
    if len(first):
        yield pa.RecordBatch.from_arrays(
            [pa.array(C.signed(C.mix(doc[first].astype(np.uint64)))), pa.array(doc[first]),
             pa.array(start[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(first), pa.binary()),
             pa.array(ref[first]), pa.array(ref_start[first].astype(np.int32))],
            names=names)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.own("lempel_ziv")
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        ids = batch.column("doc").to_numpy()
        for a, b in C.steps(offsets, 4 * C.CHUNK):
            yield from _windows(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], ids[a:b])


def _spans(doc, start, n, ref, ref_start, kind=0, anchor=None, tag=None) -> pa.RecordBatch:
    zero = np.zeros(len(doc), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(start.astype(np.int32)),
         pa.array(n.astype(np.int32)), pa.array(ref), pa.array(ref_start.astype(np.int32)),
         pa.array(zero if anchor is None else anchor), pa.array(zero if tag is None else tag)],
        names=["kind", "doc", "start", "n", "ref", "ref_start", "anchor", "tag"])


def _parser(seen_limit: int):
    """Factors of the rows of each block, which stand in document order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the block that the last batch ended in, its windows and where each stands first
        block, seen, places = None, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for batch in batches:
            settled = batch.column("tags").is_null().to_numpy(zero_copy_only=False)
            if settled.any():
                done = batch.filter(pa.array(settled))
                yield _spans(*(done.column(c).to_numpy() for c in ("doc", "start", "n", "ref", "ref_start")))
                batch = batch.filter(pa.array(~settled))
            if not len(batch):
                continue
            anchors, counts = batch.column("anchor").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            raw, _ = C.flat(batch.column("tags"))
            tag = np.zeros((len(raw) // TAG, 8), np.uint8)
            tag[:, :TAG] = raw.reshape(-1, TAG)
            tag = tag.view(np.uint64).ravel()
            anchor = np.repeat(anchors, counts)
            row = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(counts) - counts
            doc = batch.column("doc").to_numpy()[row]
            start = batch.column("start").to_numpy()[row].astype(np.int64) + np.arange(len(row)) - first[row]
            key = C.mix(tag + C.mix(anchor.view(np.uint64)))
            repeats, place = np.zeros(len(key), bool), np.stack([doc, start], 1)
            ref = place.copy()
            again = C.repeated(key)
            again = again[np.argsort(key[again], kind="stable")]
            if len(again):
                later = np.r_[False, key[again][1:] == key[again][:-1]]
                repeats[again], ref[again] = later, place[again[_heads(later)]]
            late = np.zeros(len(key), bool)
            goes_on = block is not None and anchors[0] == block
            if goes_on:
                end = int(np.searchsorted(anchor, block, "right"))
                at = np.searchsorted(seen, key[:end])
                at[at == len(seen)] = 0
                hit = np.flatnonzero(seen[at] == key[:end])
                repeats[hit], ref[hit] = True, places[at[hit]]
                if len(seen) >= seen_limit:
                    late[:end] = ~repeats[:end]
            if goes_on and anchors[-1] == block:
                if len(seen) < seen_limit:
                    seen, at = np.unique(np.concatenate([seen, key]), return_index=True)
                    places = np.concatenate([places, place])[at]
            else:
                block = anchors[-1]
                low = int(np.searchsorted(anchor, block))
                seen, at = np.unique(key[low:], return_index=True)
                places = place[low:][at]
            # the same place of two rows of one ID is no repeat
            keep = np.flatnonzero(repeats & (ref != place).any(1))
            doc_at, start_at, ref = doc[keep], start[keep], ref[keep]
            cut = _runs(doc_at, start_at, ref[:, 0], follows=ref[:, 1])
            yield _spans(doc_at[cut], start_at[cut], np.diff(np.append(cut, len(keep))), ref[cut, 0], ref[cut, 1])
            if late.any():
                yield _spans(doc[late], start[late], np.ones(late.sum(), np.int64), doc[late], start[late], 1, anchor[late], C.signed(tag[late]))
    return run


def factors(docs: DataFrame, seen_limit: int = SEEN) -> DataFrame:
    """doc, start, n, ref, ref_start: ``n`` windows from word ``start`` on stand in ``ref`` from word ``ref_start`` on, which is earlier."""
    keyed = docs.select(C.doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    rows = keyed.mapInArrow(_indexed, _ROWS).repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    found = durable(rows.mapInArrow(_parser(seen_limit), _SPANS))
    settled = found.where("kind = 0").select("doc", "start", "n", "ref", "ref_start")
    late = found.where("kind = 1").select("doc", "start", "anchor", "tag")
    if late.isEmpty():
        return settled
    first = late.groupBy("anchor", "tag").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("many"))
    more = late.join(first.where("many > 1"), ["anchor", "tag"]).where(F.struct("doc", "start") != F.col("first"))
    return settled.unionByName(more.select(
        "doc", "start", F.lit(1).alias("n"), F.col("first.doc").alias("ref"), F.col("first.start").alias("ref_start")))


def spans(docs: DataFrame, seen_limit: int = SEEN) -> DataFrame:
    """doc, start, n: runs of ``n`` windows from word ``start`` on that stand earlier in the corpus, one row for each factor."""
    return factors(docs, seen_limit).select("doc", "start", "n")


def _with_spans(docs: DataFrame, seen_limit: int) -> DataFrame:
    by_doc = spans(docs, seen_limit).groupBy(F.col("doc").alias("_ll_of")).agg(
        F.collect_list(F.struct("start", "n")).alias("_ll_spans"))
    keyed = docs.withColumn("_ll_doc", C.doc_key(F.col("doc_id"), F.col("text")))
    return keyed.join(by_doc, F.col("_ll_doc") == F.col("_ll_of"), "left").drop("_ll_of", "_ll_doc")


def _kept(text: bytes | None, found) -> tuple[list[bytes], int]:
    """The words that stay, and the number of all words."""
    parts = (text or b"").split()
    if not found:
        return parts, len(parts)
    edge = np.zeros(len(parts) + WINDOW + 1, np.int64)
    for span in found:
        edge[span["start"]] += 1
        edge[min(span["start"] + span["n"] + WINDOW - 1, len(parts))] -= 1
    stays = np.cumsum(edge)[: len(parts)] <= 0
    return [parts[i] for i in np.flatnonzero(stays).tolist()], len(parts)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("_ll_spans").to_pylist()):
            parts, n = _kept(text, found)
            rows.append((n, n - len(parts), hashlib.sha256(b" ".join(parts)).hexdigest()))
        n, removed, sha = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame, seen_limit: int = SEEN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(slim, seen_limit).select("doc_id", "text", "_ll_spans").mapInArrow(
        _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, seen_limit: int = SEEN) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (kept words joined by a blank) and ``n_chars`` set.

    Texts without a repeated passage stay as they are; every row stays.
    """
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, found in enumerate(batch.column("_ll_spans").to_pylist()):
                if found:
                    texts[i] = b" ".join(_kept(texts[i].encode(), found)[0]).decode()
            text = pa.array(texts, batch.column("text").type)
            columns = {"text": text}
            if "n_chars" in schema.names:
                length = pa.compute.utf8_length(text).cast(batch.column("n_chars").type)
                columns["n_chars"] = pa.compute.if_else(batch.column("_ll_spans").is_valid(), length, batch.column("n_chars"))
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in schema.names], names=schema.names)

    return _with_spans(docs, seen_limit).mapInArrow(cut, schema)
