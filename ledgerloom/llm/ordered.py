"""SHA-256 of the members of each group, in order and joined by commas, whatever the size of a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Characters of members that one row carries on.
PIECE = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive members of a group as one text."""
    part, seq, at, texts, size = TaskContext.get().partitionId(), 0, None, [], 0

    def piece():
        return pa.RecordBatch.from_arrays(
            [pa.array([at]), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(texts)], pa.int64()),
             pa.array([",".join(texts)])], names=["key", "part", "seq", "n", "texts"])

    for batch in batches:
        for key, member in zip(batch.column("key").to_pylist(), batch.column("member").to_pylist()):
            if texts and (key != at or size > PIECE):
                yield piece()
                seq, texts, size = seq + 1, [], 0
            at = key
            texts.append(member)
            size += len(member) + 1
    if texts:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, n, sha = None, 0, None

    def group():
        return pa.RecordBatch.from_arrays(
            [pa.array([at]), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["key", "n", "sha"])

    for batch in batches:
        for key, more, texts in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "texts"))):
            if sha is None or key != at:
                if sha is not None:
                    yield group()
                at, n, sha = key, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(texts.encode())
            n += more
    if sha is not None:
        yield group()


def digests(members: DataFrame, order: str = "member") -> DataFrame:
    """(key, n, sha) of ``members`` (key string, member string and the column ``order`` to sort by).

    A group of any size is sorted by all tasks and shortened there to pieces of
    text; only these pieces, not its rows, meet in one task, which hashes them
    one after the other. An empty group has no row.
    """
    ranged = members.repartitionByRange("key", order).sortWithinPartitions("key", order).select("key", "member")
    pieces = ranged.mapInArrow(_joined, "key string, part int, seq long, n long, texts string")
    return pieces.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(
        _hashed, "key string, n long, sha string")


def empty_digest():
    return F.lit(hashlib.sha256(b"").hexdigest())
