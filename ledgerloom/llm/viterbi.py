"""SentencePiece encoding and decoding by a batched Viterbi search.

A text becomes pieces as the piece model asks: a word mark in front and for
every blank, then for each word (word marks and the characters up to the next
ones) the pieces of the largest total score. Words of one length advance
together: the hashes of all their substrings are looked up in the sorted
hashes of the pieces, and the best way to every place is a maximum over the
piece lengths, kept as a backpointer. Of equally good ways the one with the
shorter last piece is taken. A character that no piece holds costs more than
any piece and is spelt in byte pieces.

Scores are the model's own. Decoding joins the pieces' bytes and gives the
text back, except that a word mark in the text itself becomes a blank.

Null or empty text has no pieces and decodes to the empty text. Rows are taken
one by one, so repeated rows and repeated or null IDs give a row each; further
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import common as C

MARK = "▁"
REMEMBERED = 500_000
#: Characters of words that are searched together.
TOGETHER = 1 << 18
_FACTOR, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """The pieces of a model file, by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(count)]
        usual = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.load([(texts[i], model.get_score(i), i) for i in usual])
        self.byte_id = np.zeros(256, np.int64)
        self.bytes = [text.replace(MARK, " ").encode() for text in texts]
        for i in range(count):
            if model.is_byte(i):
                value = int(texts[i][3:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes[i] = b""
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.memory = C.Memory(self.search, REMEMBERED)

    def load(self, pieces: list[tuple[str, float, int]]) -> None:
        self.longest = max(len(t) for t, _, _ in pieces)
        self.unknown = min(s for _, s, _ in pieces) - 10.0
        keys = np.zeros(len(pieces), np.uint64)
        for size in range(1, self.longest + 1):
            own = [i for i, (t, _, _) in enumerate(pieces) if len(t) == size]
            if own:
                points = np.array([list(map(ord, pieces[i][0])) for i in own], np.uint64)
                keys[own] = self._of_length(self._sums(points), size)[:, 0]
        order = np.argsort(keys)
        self.keys = keys[order]
        self.scores = np.array([s for _, s, _ in pieces])[order]
        self.ids = np.array([i for _, _, i in pieces], np.int64)[order]

    def _sums(self, points: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        np.cumsum(C.mix(points + C.U64(1)) * C.powers(points.shape[1], _FACTOR), axis=1, out=sums[:, 1:])
        return sums

    def _of_length(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        return C.mix((sums[:, size:] - sums[:, :-size]) * C.powers(sums.shape[1], _INVERSE)[: sums.shape[1] - size])

    def search(self, words: list[str]) -> list[list[int]]:
        """The best pieces of each word."""
        found: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, members in by_length.items():
            step = max(1, TOGETHER // length)
            for at in range(0, len(members), step):
                some = members[at: at + step]
                raw = "".join(words[i] for i in some).encode("utf-32-le", "surrogatepass")
                points = np.frombuffer(raw, np.uint32).reshape(len(some), length)
                for i, ids in zip(some, self._advance(points)):
                    found[i] = ids
        return found

    def _advance(self, points: np.ndarray) -> list[list[int]]:
        many, length = points.shape
        sums = self._sums(points.astype(np.uint64))
        best = np.full((length + 1, many), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, many), np.int8)
        piece = np.full((length + 1, many), -1, np.int64)
        at, scores = [], []
        for size in range(1, min(self.longest, length) + 1):
            key = self._of_length(sums, size)
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            hit = self.keys[k] == key
            at.append(np.where(hit, k, -1).T)
            scores.append(np.where(hit, self.scores[k], self.unknown if size == 1 else -np.inf).T)
        for end in range(1, length + 1):
            for size in range(1, min(self.longest, end) + 1):
                way = best[end - size] + scores[size - 1][end - size]
                better = way > best[end]
                best[end] = np.where(better, way, best[end])
                back[end] = np.where(better, size, back[end])
                piece[end] = np.where(better, at[size - 1][end - size], piece[end])
        out: list[list[int]] = []
        back, piece = back.T, piece.T
        for row in range(many):
            ids, end, own_back, own_piece = [], length, back[row].tolist(), piece[row].tolist()
            while end:
                k, size = own_piece[end], own_back[end]
                if k >= 0:
                    ids.append(int(self.ids[k]))
                else:
                    ids.extend(int(self.byte_id[b]) for b in reversed(chr(points[row, end - 1]).encode("utf-8", "surrogatepass")))
                end -= size
            out.append(ids[::-1])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """IDs of all texts and the offsets of each."""
        words, counts = [], []
        for text in texts:
            own = _WORD.findall(MARK + text.replace(" ", MARK)) if text else []
            words += own
            counts.append(len(own))
        ids, length = self.memory(words)
        return ids, np.r_[0, np.cumsum(C.per_document(length, np.r_[0, np.cumsum(counts)].astype(np.int64)))].astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each sequence of IDs."""
        size = self.size[ids]
        ends = np.r_[0, np.cumsum(size)]
        raw = self.blob[np.repeat(self.first[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip(cut[:-1], cut[1:])]


_SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Piece counts, checksums and the proof of decoding of every row; ``with_ids`` adds the IDs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            _, offsets = C.flat(batch.column("text"))
            for a, b in C.steps(offsets):
                texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
                ids, bounds = pieces.encode(texts)
                back = pieces.decode(ids, bounds)
                parts = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                columns = [
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([t.replace(MARK, " ") == r for t, r in zip(texts, back)], pa.bool_())]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"] if with_ids else names)
        pieces.memory.close()

    schema = _SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of IDs (``ids``; null counts as none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            rows = [np.array(r or [], np.int64) for r in batch.column("ids").to_pylist()]
            bounds = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
            texts = pieces.decode(np.concatenate([np.zeros(0, np.int64), *rows]), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
