"""Interpolated modified Kneser-Ney bigram model.

Bigrams are counted in Spark: each task counts its own text, the counts meet
in shards by the hash of the bigram (so a frequent word is no hot key), and
every shard writes its bigrams as a sorted array of hashes with a parallel
array of counts. Of each word it passes on the partial sums that the model
needs (occurrences, words before it, words after it by how often they follow);
those meet in shards by word and become sorted arrays too. The arrays lie in
the shared folder; the scoring tasks map them into memory and look up whole
batches at once.

Words are hashes of 47 bits: among V words about V * V / 2**48 share theirs.

Null or empty text is the end token alone. Rows without an ID count by the
empty text's checksum. Repeated rows are counted and scored row by row. With
nothing to learn from, every word is unknown and the model is uniform. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import common as C
from ledgerloom.runtime import durable, scratch_root

WORD_BITS = C.U64((1 << 48) - 1)
END, START = C.U64(1), C.U64(2)
#: Tokens that are counted together before the shuffle.
COUNTED = 2_500_000
_FIELDS = (("c", "<u8"), ("after", "<u8"), ("before", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"))


# --- arrays in the shared folder ---------------------------------------------

def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def store_array(uri: str, array: np.ndarray) -> None:
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        array.tofile(path)
        return
    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))


def map_array(uri: str, kind: str, length: int) -> np.ndarray:
    """The stored array, mapped into memory; from a store without local paths by an unnamed copy."""
    if not length:
        return np.zeros(0, kind)
    path = _local(uri)
    if path:
        return np.memmap(path, kind, "r", shape=(length,))
    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(at) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, kind, "r", shape=(length,))


# --- tokens ------------------------------------------------------------------

def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and the offsets of the texts."""
    data = C.LOWER[data]
    starts, ends, before = C.words(data, offsets)
    h = (C.span_hash(C.prefix(data), starts, ends) & WORD_BITS) | C.U64(4)
    bounds = before + np.arange(len(before))
    tokens = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[bounds[1:] - 1] = False
    tokens[inside] = h
    return tokens, bounds


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[bounds[:-1]] = START
    return contexts


def _pair(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return C.mix(contexts * C.U64(0xD6E8FEB86659FD93) + tokens)


def _six(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


# --- counting ----------------------------------------------------------------

_PAIRS = "shard int, contexts binary, runs binary, words binary, counts binary"
_SUMS = "shard int, kind int, words binary, sums binary, path string, n long, facts array<long>"


def _counted(contexts: np.ndarray, tokens: np.ndarray, bits: int) -> pa.RecordBatch:
    """Bigram counts by shard; contexts are stored once for their run of words."""
    shard = _pair(contexts, tokens) >> C.U64(64 - bits)
    packed = (shard << C.U64(48)) | contexts
    order = np.lexsort((tokens, packed))
    packed, words = packed[order], tokens[order]
    first = np.flatnonzero(np.r_[True, (packed[1:] != packed[:-1]) | (words[1:] != words[:-1])])
    counts = np.diff(np.append(first, len(words))).astype(np.uint32)
    packed, words = packed[first], words[first]
    run = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    runs = np.diff(np.append(run, len(packed))).astype(np.uint32)
    shards = (packed[run] >> C.U64(48)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(run))):
        low, high = run[a], run[b] if b < len(run) else len(packed)
        rows.append((shards[a], _six(packed[run[a:b]] & WORD_BITS), runs[a:b].tobytes(), _six(words[low:high]), counts[low:high].tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["shard", "contexts", "runs", "words", "counts"])


def _counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, tokens, held = [], [], 0
        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            for a, b in C.steps(offsets):
                found, bounds = _tokens(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                tokens.append(found)
                contexts.append(_contexts(found, bounds))
                held += len(found)
                if held >= COUNTED:
                    yield _counted(np.concatenate(contexts), np.concatenate(tokens), bits)
                    contexts, tokens, held = [], [], 0
        if held:
            yield _counted(np.concatenate(contexts), np.concatenate(tokens), bits)
    return run


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["shard", "kind", "words", "sums", "path", "n", "facts"])


def _by_shard(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Each shard's rows, which follow each other."""
    shard, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("shard", *names))):
            if row[0] != shard and rows:
                yield shard, rows
                rows = []
            shard = row[0]
            rows.append(row[1:])
    if rows:
        yield shard, rows


def _pair_table(folder: str, bits: int):
    """Writes each shard's bigrams and passes on the sums of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches, ("contexts", "runs", "words", "counts")):
            contexts = np.concatenate([np.repeat(_eight(c), np.frombuffer(r, np.uint32)) for c, r, _, _ in rows])
            words = np.concatenate([_eight(w) for _, _, w, _ in rows])
            counts = np.concatenate([np.frombuffer(n, np.uint32) for *_, n in rows]).astype(np.uint64)
            key = _pair(contexts, words)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total = np.add.reduceat(counts[order], first)
            key, contexts, words = key[first], contexts[order][first], words[order][first]
            path = f"{folder}/pairs-{shard}-{uuid.uuid4().hex}"
            store_array(f"{path}.hash", key)
            store_array(f"{path}.n", np.minimum(total, 0xFFFFFFFF).astype(np.uint32))
            yield _sums_batch([(shard, 0, None, None, path, len(key), [int((total == k).sum()) for k in (1, 2, 3, 4)])])
            # the sums of every word in the shard
            names, at = np.unique(np.concatenate([contexts, words]), return_inverse=True)
            of_context, of_word = at[: len(contexts)], at[len(contexts):]
            size = len(names)

            def add(where, weight=None):
                return np.bincount(where, weight, minlength=size).astype(np.uint64)

            sums = np.stack([
                add(of_word, total), add(of_context, total), add(of_word), add(of_context[total == 1]),
                add(of_context[total == 2]), add(of_context[total > 2])])
            home = (C.mix(names) >> C.U64(64 - bits)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            edge = np.searchsorted(home[order], np.arange((1 << bits) + 1))
            out = []
            for s in np.flatnonzero(np.diff(edge)):
                some = order[edge[s]: edge[s + 1]]
                some = some[np.argsort(names[some])]
                out.append((s, 1, _six(names[some]), sums[:, some].astype(np.uint32).tobytes()
                            if sums[:, some].max() <= 0xFFFFFFFF else sums[:, some].tobytes(), None, len(some), None))
            yield _sums_batch(out)
    return run


def _word_table(folder: str):
    """Writes each shard's words; the notes on the bigram tables go through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches, ("kind", "words", "sums", "path", "n", "facts")):
            notes = [r for r in rows if r[0] == 0]
            yield _sums_batch([(shard, 0, None, None, r[3], r[4], r[5]) for r in notes])
            rows = [r for r in rows if r[0] == 1]
            if not rows:
                continue
            names = np.concatenate([_eight(r[1]) for r in rows])
            sums = np.concatenate([
                np.frombuffer(r[2], np.uint32 if len(r[2]) == 24 * r[4] else np.uint64).reshape(6, -1).astype(np.uint64) for r in rows], axis=1)
            order = np.argsort(names, kind="stable")
            names = names[order]
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            names, sums = names[first], np.add.reduceat(sums[:, order], first, axis=1)
            path = f"{folder}/words-{shard}-{uuid.uuid4().hex}"
            store_array(f"{path}.hash", names)
            for (field, kind), values in zip(_FIELDS, sums):
                store_array(f"{path}.{field}", values.astype(kind))
            c, before = sums[0], sums[2]
            facts = [int(c.sum()), int((c > 0).sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)),
                     int((before > 2).sum())]
            yield _sums_batch([(shard, 2, None, None, path, len(names), facts)])
    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; 0.5, 1 and 1.5 where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found)]


def train(docs: DataFrame) -> dict:
    """Places of the arrays and the constants of the model; one note for each shard reaches the driver."""
    spark = docs.sparkSession
    bits = min(16, max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))  # a shard's number has 16 bits
    folder = f"{scratch_root(spark)}/lm-{uuid.uuid4().hex}"
    known = docs.where(~_held_out()).select("text")
    pairs = known.mapInArrow(_counter(bits), _PAIRS).repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard")
    sums = pairs.mapInArrow(_pair_table(folder, bits), _SUMS).repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard", "kind")
    notes = durable(sums.mapInArrow(_word_table(folder), _SUMS).select("shard", "kind", "path", "n", "facts")).collect()
    pairs, words = [r for r in notes if r["kind"] == 0], [r for r in notes if r["kind"] == 2]
    add = lambda rows, size: [sum(r["facts"][i] for r in rows) for i in range(size)]
    n, v, types, b1, b2, b3, b4, many = add(words, 8)
    low = _discounts(b1, b2, b3, b4)
    return {
        "bits": bits, "n": n, "v": v, "types": types, "high": _discounts(*add(pairs, 4)), "low": low,
        "rest": (low[0] * b1 + low[1] * b2 + low[2] * many) / types if types else 1.0,
        "pairs": {r["shard"]: (r["path"], r["n"]) for r in pairs}, "words": {r["shard"]: (r["path"], r["n"]) for r in words}}


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


# --- scoring -----------------------------------------------------------------

class Model:
    """Looks up batches in the mapped arrays."""

    def __init__(self, plan: dict):
        self.plan = plan
        self.pairs = {s: (map_array(f"{p}.hash", "<u8", n), map_array(f"{p}.n", "<u4", n)) for s, (p, n) in plan["pairs"].items()}
        self.words = {s: (map_array(f"{p}.hash", "<u8", n), {f: map_array(f"{p}.{f}", k, n) for f, k in _FIELDS})
                      for s, (p, n) in plan["words"].items()}

    def _shards(self, ordered: np.ndarray):
        """Ranges of ordered hashes by shard."""
        bits = C.U64(64 - self.plan["bits"])
        edge = np.searchsorted(ordered >> bits, np.arange((1 << self.plan["bits"]) + 1))
        return [(s, edge[s], edge[s + 1]) for s in np.flatnonzero(np.diff(edge)).tolist()]

    def word_sums(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """The sums of distinct words; zeros for unknown ones."""
        spread = C.mix(words)
        order = np.argsort(spread)
        out = {f: np.zeros(len(words)) for f, _ in _FIELDS}
        for shard, low, high in self._shards(spread[order]):
            if shard not in self.words:
                continue
            names, sums = self.words[shard]
            some = order[low:high]
            some = some[np.argsort(words[some])]
            at = np.minimum(np.searchsorted(names, words[some]), len(names) - 1)
            hit = names[at] == words[some]
            for f in out:
                out[f][some[hit]] = sums[f][at[hit]]
        return out

    def pair_counts(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        key = _pair(contexts, tokens)
        order = np.argsort(key)
        key, found = key[order], np.zeros(len(key))
        for shard, low, high in self._shards(key):
            if shard in self.pairs:
                names, counts = self.pairs[shard]
                at = np.minimum(np.searchsorted(names, key[low:high]), len(names) - 1)
                hit = names[at] == key[low:high]
                found[low:high][hit] = counts[at[hit]]
        out = np.empty(len(key))
        out[order] = found
        return out

    def log10(self, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each token after its context, and its count in training."""
        plan = self.plan
        words, at = np.unique(np.concatenate([contexts, tokens]), return_inverse=True)
        sums = self.word_sums(words)
        context, token = at[: len(contexts)], at[len(contexts):]
        high, low = np.array([0.0, *plan["high"]]), np.array([0.0, *plan["low"]])
        before = sums["before"]
        lower = np.maximum(before - low[np.minimum(before, 3).astype(int)], 0) / max(plan["types"], 1) + plan["rest"] / (plan["v"] + 1)
        after = sums["after"]
        some = np.maximum(after, 1)
        weight = np.where(after > 0, (high[1] * sums["n1"] + high[2] * sums["n2"] + high[3] * sums["n3"]) / some, 1.0)
        seen = self.pair_counts(contexts, tokens)
        own = np.maximum(seen - high[np.minimum(seen, 3).astype(int)], 0) / some[context]
        return np.log10(own + weight[context] * lower[token]), sums["c"][token]


_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, plan: dict) -> DataFrame:
    """Counts and scores of every row, see the module."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n, v = Model(plan), plan["n"], plan["v"]
        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            for a, b in C.steps(offsets, 4 * C.CHUNK):
                tokens, bounds = [], [np.zeros(1, np.int64)]
                for low, high in C.steps(offsets[a: b + 1]):
                    found, edge = _tokens(data[offsets[a + low]: offsets[a + high]], offsets[a + low: a + high + 1] - offsets[a + low])
                    tokens.append(found)
                    bounds.append(bounds[-1][-1] + edge[1:])
                tokens, bounds = np.concatenate(tokens), np.concatenate(bounds)
                logs, count = model.log10(_contexts(tokens, bounds), tokens)
                base = np.log10((count + 1) / (n + v + 1))
                parts.append((np.diff(bounds), np.add.reduceat((count > 0).astype(np.int64), bounds[:-1]),
                              np.add.reduceat(base, bounds[:-1]), np.add.reduceat(logs, bounds[:-1])))
            size, known, base, logs = (np.concatenate(p) for p in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(known),
                 pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(logs)],
                names=[c.split()[0] for c in _SCORES.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return slim.mapInArrow(run, _SCORES)
