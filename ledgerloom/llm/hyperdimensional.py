"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds the
three letter vectors, rotated by their places, by multiplication; a document is
the bundle (sum) of its trigram vectors, a language the bundle of its training
documents. The language whose prototype, less the part common to all
prototypes, has the largest cosine with the document is predicted.

A letter is any character that Unicode calls one, in lower case; its vector is
drawn from a hash of its code point, so every script has letters of its own and
no alphabet is listed. Anything else is a word border. Training sums bundles:
each task gives one vector for each language it saw, and vectors add up, so
neither the driver nor a task holds counts of trigrams. Null text and text without a letter give ``und`` and
score 0. Rows with a null language are not learnt from; without any language
to learn from, every prediction is ``und``. Equal cosines take the first
language by name. Rows without an ID count by the empty text's checksum.
Repeated rows give a row each; further columns are ignored; an empty table gives
no rows. Texts of any length are read whole: their trigrams are bound ``BLOCK``
distinct ones at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import common as C

DIMENSIONS = 1024
#: Sharpness of the score, a softmax of the cosines.
SHARPNESS = 20.0
#: Distinct trigrams bound at once, and rows bundled at once.
BLOCK, ROWS = 1 << 15, 1 << 12
#: Bits of a code point.
_WIDE = 21


def _symbol(point: int) -> int:
    letter = chr(point).lower()[0]
    return ord(letter) if letter.isalpha() else 0


def _symbols(points: np.ndarray) -> np.ndarray:
    """Code point of the lower-case letter, or 0 for a border."""
    tables = C.kept()
    if "symbols" not in tables:
        tables["symbols"] = np.array([_symbol(p) for p in range(1 << 16)], np.int64)
    found = tables["symbols"][np.minimum(points, 0xFFFF)]
    for point in np.unique(points[points > 0xFFFF]):
        found[points == point] = _symbol(int(point))
    return found


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, as int8."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    drawn = C.mix(C.mix(points.astype(np.uint64)[:, None] + C.U64(0x51ED27)) + words * C.U64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(drawn.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits * 2).astype(np.int8) - np.int8(1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vector of each trigram, as int8."""
    mask = (1 << _WIDE) - 1
    bound = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(3):
        letters, at = np.unique(grams >> (_WIDE * (2 - place)) & mask, return_inverse=True)
        bound *= np.roll(letter_vectors(letters), 2 - place, axis=1)[at]
    return bound


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and trigram of every place, and whether a row has letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = C.per_document((data & 0xC0) != 0x80, offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = _symbols(points)
    lettered = np.bincount(owner[symbols > 0], minlength=len(lengths)) > 0
    # one border before and after each row, and one for each run of other characters
    at = np.arange(len(points)) + 2 * owner + 1
    line = np.zeros(len(points) + 2 * len(lengths), np.int64)
    line[at] = symbols
    row = np.repeat(np.arange(len(lengths)), lengths + 2)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] > 0) | (line[:-1] > 0) | (row[1:] != row[:-1])
    line, row = line[keep], row[keep]
    if len(line) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    grams = line[:-2] << 2 * _WIDE | line[1:-1] << _WIDE | line[2:]
    whole = (row[2:] == row[:-2]) & (grams > 0)
    return row[2:][whole], grams[whole], lettered


def _bundles(owner: np.ndarray, grams: np.ndarray, owners: int) -> np.ndarray:
    """Sum of the bound vectors of each owner's trigrams; whole numbers, so exact."""
    bundles = np.zeros((owners, DIMENSIONS))
    known, at = np.unique(grams, return_inverse=True)
    for low in range(0, len(known), BLOCK):
        vectors = gram_vectors(known[low: low + BLOCK])
        inside = (at >= low) & (at < low + BLOCK)
        keys, count = np.unique(owner[inside] * BLOCK + at[inside] - low, return_counts=True)
        cut = np.searchsorted(keys, np.arange(owners + 1) * BLOCK)
        for i in np.flatnonzero(np.diff(cut)):
            for a in range(cut[i], cut[i + 1], 2048):
                b = min(a + 2048, cut[i + 1])
                # sums stay whole: single precision holds them up to 2**24
                kind = np.float32 if count[a:b].sum() < 1 << 24 else np.float64
                bundles[i] += count[a:b].astype(kind) @ vectors[keys[a:b] % BLOCK].astype(kind)
    return bundles


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        names, which = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        for a, b in C.steps(offsets):
            row, grams, _ = _grams(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            for name, bundle in zip(names, _bundles(which[a:b][row], grams, len(names))):
                totals[str(name)] = totals.get(str(name), 0) + bundle
    for name, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(total.astype(np.int64))],
            names=["lang", "dimension", "n"])


def train(docs: DataFrame) -> dict:
    """Languages and their prototypes, from rows that are not held out.

    The driver gets one vector for each language, however large the corpus.
    """
    known = docs.where("lang is not null").where(~_held_out()).select(F.col("lang").cast("string").alias("lang"), "text")
    rows = (
        known.mapInArrow(_totals, "lang string, dimension long, n long")
        .groupBy("lang", "dimension").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(rows["lang"].unique())
    prototypes = np.zeros((len(names), DIMENSIONS))
    for k, name in enumerate(names):
        own = rows[rows["lang"] == name]
        prototypes[k, own["dimension"].to_numpy()] = own["n"].to_numpy(float)
        prototypes[k] /= np.linalg.norm(prototypes[k]) or 1.0
    if len(names) > 1:
        prototypes -= prototypes.mean(0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return {"names": names, "prototypes": prototypes}


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    names, prototypes = model["names"], model["prototypes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            guess, score = ["und"] * len(batch), np.zeros(len(batch))
            parts = [(low, min(low + ROWS, b)) for a, b in C.steps(offsets) for low in range(a, b, ROWS)] if names else []
            for a, b in parts:
                row, grams, lettered = _grams(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                bundles = _bundles(row, grams, b - a)
                cosines = bundles @ prototypes.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
                best = cosines.argmax(1)
                sure = 1 / np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True))).sum(1)
                for i in np.flatnonzero(lettered):
                    guess[a + i], score[a + i] = names[best[i]], sure[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(guess, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
