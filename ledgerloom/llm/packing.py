"""Vector bin packing of documents into training sequences.

Each sequence has limits on three loads at once: tokens, segments and
loss-bearing tokens. An open sequence takes, of a window of waiting documents,
the fitting one whose load vector has the largest dot product with the room
left (all as shares of the limits); when none fits, the one with the largest
dot product is cut to the room. Whole sequences of one document skip the
window. Every task packs its own rows; the tokens it has left at its end go
to sequences whose lengths are powers of two, which need no padding.

Null or empty text is the end token alone. Repeated rows and repeated or null
IDs are packed row by row. An empty table gives no pieces; further columns
are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import common as C

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (2048, 256, 2048)
END = 1
#: Documents that wait for a place, and words a worker remembers.
WAITING, REMEMBERED = 256, 400_000
#: Bytes of text encoded in one step: the more, the fewer words come up again in another step.
STEP = 4 << 20
#: Words that the tokenizer gets at once: what it returns takes some hundred times the bytes of a word.
BATCH = 2048
#: Words whose IDs are put in place at once.
GATHER = 1 << 16
#: Bytes of words whose end can be encoded apart, and those of such ends.
LETTER, ENDING = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = ENDING[list(b".,;:!?")] = True


def _plain(word: bytes) -> bool:
    """Lower-case letters alone, which neither the normaliser nor the word pattern changes."""
    text = word.decode()
    return text.isalpha() and (word.isascii() and word.islower() or text == text.lower() and unicodedata.is_normalized("NFC", text))


class WordEncoder:
    """Token IDs of texts, word by word: the vocabulary never joins tokens across ASCII white space.

    Nor does it join those of plain letters and of the marks after them, so
    such a word is remembered without its marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For lower-case letters alone neither the normaliser nor the word pattern has anything to do.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.memory = C.Memory(self._encode, REMEMBERED, BATCH)

    def close(self) -> None:
        """Lets go of all words and of the tokenizers."""
        self.memory.close()
        self.tokenizer, self.letters = None, None

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        plain = [_plain(w) for w in words]
        found: list = [None] * len(words)
        for tokenizer, kind in ((self.letters, True), (self.tokenizer, False)):
            at = [i for i, p in enumerate(plain) if p is kind]
            for i, e in zip(at, tokenizer.encode_batch_fast([words[i].decode() for i in at], add_special_tokens=False)):
                found[i] = e.ids
        return found

    @staticmethod
    def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The end of each word without the marks after its letters; of any other word, its end."""
        marks = np.add.reduceat(~(LETTER | C.SPACE)[data], starts, dtype=np.int32)
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(ENDING[data], dtype=np.int32, out=sums[1:])
        stems = np.where((marks < ends - starts) & (sums[ends] - sums[ends - marks] == marks), ends - marks, ends)
        del sums
        # of letters beyond a-z not all are lower case
        doubt = np.flatnonzero((stems < ends) & np.logical_or.reduceat(data > 127, starts))
        which, words = C.distinct(data, starts[doubt], stems[doubt])
        doubt = doubt[~np.array([_plain(w) for w in words], bool)[which]]
        stems[doubt] = ends[doubt]
        return stems

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """IDs of all texts, each with its end token, and the offsets of each."""
        # lower case comes first, but for the names of special tokens, which it would change
        if not ((data[:-1] == 60) & (data[1:] == 124)).any():
            data = C.LOWER[data]
        starts, ends, before = C.words(data, offsets)
        if not len(starts):
            return np.full(len(offsets) - 1, END, np.uint32), np.arange(len(offsets))
        stems = self._stems(data, starts, ends)
        which, words = C.distinct(data, starts, stems)
        tailed = np.flatnonzero(stems < ends)
        tail, tails = C.distinct(data, stems[tailed], ends[tailed])
        found, sizes = self.memory(words + tails)
        # a tail follows its stem
        shift = np.zeros(len(starts) + 1, np.int64)
        shift[tailed + 1] = 1
        np.cumsum(shift, out=shift)
        parts = np.zeros(len(starts) + len(tailed), np.int64)
        parts[np.arange(len(starts)) + shift[:-1]] = which
        parts[tailed + shift[tailed] + 1] = len(words) + tail
        first, before = np.cumsum(sizes) - sizes, before + shift[before]
        del starts, ends, stems, words, which, tailed, tail, tails, shift
        bounds = np.r_[0, np.cumsum(C.per_document(sizes[parts], before) + 1)]
        target = np.ones(bounds[-1], bool)
        target[bounds[1:] - 1] = False
        ids, target = np.full(bounds[-1], END, np.uint32), np.flatnonzero(target)
        at = 0
        for low in range(0, len(parts), GATHER):
            length, begin = sizes[parts[low: low + GATHER]], first[parts[low: low + GATHER]]
            total = int(length.sum())
            ids[target[at: at + total]] = found[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(total)]
            at += total
        return ids, bounds


class Packer:
    """Places items of one stream; ``add`` and ``finish`` yield (item, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], waiting: int = WAITING):
        self.limits, self.waiting = limits, waiting
        self.cap = np.array(limits, float)
        self.items: list = []  # [item, start, end, sums of loss flags]
        self.loads = np.zeros((0, 3))
        self.sequence = -1

    def _loss(self, entry, start: int, end: int) -> int:
        return end - start if entry[3] is None else int(entry[3][end] - entry[3][start])

    def _load(self, entry) -> list[float]:
        return [(entry[2] - entry[1]) / self.cap[0], 1 / self.cap[1], self._loss(entry, entry[1], entry[2]) / self.cap[2]]

    def _cut(self, entry, tokens: int, loss: int) -> int:
        """The longest beginning of an item within the room, as its end."""
        end = min(entry[2], entry[1] + tokens)
        if entry[3] is None:
            return min(end, entry[1] + loss)
        return min(end, int(np.searchsorted(entry[3], entry[3][entry[1]] + loss, "right")) - 1)

    def add(self, item, length: int, loss_flags: np.ndarray | None = None):
        sums = None if loss_flags is None else np.r_[0, np.cumsum(loss_flags.astype(np.int64))]
        entry = [item, 0, length, sums]
        while self._cut(entry, self.limits[0], self.limits[2]) - entry[1] == self.limits[0]:
            self.sequence += 1
            yield item, entry[1], self.limits[0], self.sequence, 0
            entry[1] += self.limits[0]
        if entry[1] < length:
            self.items.append(entry)
            if len(self.items) >= 2 * self.waiting:
                self.loads = np.array([self._load(e) for e in self.items])
                while len(self.items) > self.waiting:
                    yield from self._fill()

    def _fill(self):
        """One sequence from the waiting items."""
        self.sequence += 1
        tokens, segments, loss = self.limits
        offset = 0
        while self.items and tokens and segments:
            room = np.array([tokens / self.cap[0], segments / self.cap[1], loss / self.cap[2]])
            score = self.loads @ room
            fits = (self.loads <= room + 1e-12).all(axis=1)
            k = int(np.argmax(np.where(fits, score, -1.0) if fits.any() else score))
            entry = self.items[k]
            end = self._cut(entry, tokens, loss)
            size = end - entry[1]
            if not size:
                break
            yield entry[0], entry[1], size, self.sequence, offset
            tokens, segments, loss, offset = tokens - size, segments - 1, loss - self._loss(entry, entry[1], end), offset + size
            entry[1] = end
            if end == entry[2]:
                self.items[k] = self.items[-1]
                self.loads[k] = self.loads[-1]
                self.items.pop()
                self.loads = self.loads[:-1]
            else:
                self.loads[k] = self._load(entry)

    def finish(self):
        """Places what waits; a last sequence that stays open is cut to powers of two."""
        self.loads = np.array([self._load(e) for e in self.items]).reshape(-1, 3)
        while self.items:
            pieces = list(self._fill())
            used = sum(p[2] for p in pieces)
            if self.items or used == self.limits[0]:
                yield from pieces
                continue
            room, offset = 1 << (used.bit_length() - 1), 0
            for item, start, size, _, _ in pieces:
                while size:
                    part = min(size, room - offset)
                    yield item, start, part, self.sequence, offset
                    used, start, size, offset = used - part, start + part, size - part, offset + part
                    if offset == room and used:
                        room, offset = 1 << (used.bit_length() - 1), 0
                        self.sequence += 1


_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "loss_tokens long")


def pack(docs: DataFrame, path: str, limits: tuple[int, int, int] = LIMITS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds its token IDs (``ids``). All tokens of a document bear loss."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = C.own("packing")
        encode, packer = encoders.get(path) or encoders.setdefault(path, WordEncoder(path)), Packer(limits)
        base = TaskContext.get().partitionId() << 33

        def rows(placed) -> pa.RecordBatch:
            out = []
            for (doc_id, ids), start, length, sequence, offset in placed:
                part = ids[start: start + length]
                out.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), base + sequence, offset, length)
                           + ((part,) if with_ids else ()))
            columns = list(zip(*out)) if out else [()] * (8 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array(list(columns[8]), pa.list_(pa.int32())))
                names = [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in C.steps(offsets, STEP):
                ids, bounds = encode(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                placed = []
                for i in range(a, b):
                    own = ids[bounds[i - a]: bounds[i - a + 1]].copy()
                    placed += packer.add((doc_ids[i], own), len(own))
                yield rows(placed)
        yield rows(list(packer.finish()))

    schema = _SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(place, schema)
