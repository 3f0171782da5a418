"""Toxicity by weak supervision.

1. Voters: words (lexicon) and beginnings of words (patterns) that mark toxic
   training documents, chosen one after the other by what they newly cover,
   and a few fixed patterns of style.
2. A generative label model estimates each voter's rates in toxic and clean
   documents, those of the human label among them, by expectation maximisation
   over their agreement. Voters that agree beyond their rates are correlated
   and share one weight. The human label tells which class is the toxic one.
3. A logistic regression on the voters' counts is trained on the posterior
   labels of that model.

Training uses a bounded sample of labelled documents, at most ``SAMPLE`` by
the hash of their ID; every document is scored by its whole text.

Bounds of the model: at most ``CANDIDATES`` features, those of most toxic
documents of the sample (ties: fewer clean ones, then the hash), are weighed as
voters, each in at least 0.4 % of the toxic ones; at most ``VOTERS`` are chosen,
of equal gains the one with the smaller hash. Texts of any length are scored
whole; an empty table gives no rows.

Null or empty text has no features and gets the score of such a text. Rows
without an ID count as held out. A document with several labels is toxic if
one of them says so; null labels are ignored. Without labels of both kinds
every score is the smoothed share of toxic labels. Repeated rows give a row
each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import common as C
from ledgerloom.runtime import durable

SAMPLE, CANDIDATES, VOTERS = 20_000, 4_000, 160
STEMS = (4, 5, 6)

_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
_BETWEEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = False
#: Fixed patterns of style: doubled marks, masked letters, shouted letters.
_STYLES = (b"!!", b"??", b"**", b"?!", b"@#")


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) == part


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the row of each."""
    data = C.LOWER[data]
    starts, ends, before = C.words(data, offsets, _BETWEEN)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    sums = C.prefix(data)
    hashes, owners = [C.span_hash(sums, starts, ends)], [owner]
    for size in STEMS:
        at = np.flatnonzero(ends - starts >= size)
        hashes.append(C.span_hash(sums, starts[at], starts[at] + size) + C.U64(size))
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


def _styles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw, at = data.tobytes(), offsets.tolist()
    return np.array([[raw.count(mark, a, b) for mark in _STYLES] for a, b in zip(at[:-1], at[1:])], float).reshape(-1, len(_STYLES))


def _counts(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Occurrences of the ``known`` (sorted) hashes, by row."""
    rows, found = len(offsets) - 1, np.zeros(0, np.int64)
    if len(known):
        hashes, owner = _features(data, offsets)
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = known[at] == hashes
        found = owner[hit] * len(known) + at[hit]
    return np.bincount(found, minlength=rows * len(known)).reshape(rows, len(known))


def _features_of(known: np.ndarray | None):
    """Documents with each feature (of the ``known`` ones), by step of the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.own("toxicity")
        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            for a, b in C.steps(offsets, 4 * C.CHUNK):
                hashes, owner = _features(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                if known is not None:
                    at = np.searchsorted(known, hashes)
                    at[at == len(known)] = 0
                    hashes, owner = hashes[known[at] == hashes], owner[known[at] == hashes]
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                once = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
                value, count = np.unique(hashes[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(value)), pa.array(count)], names=["feature", "n"])
    return run


def _votes(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """0 or 1 of every voter, the fixed patterns last, by row."""
    return np.column_stack([_counts(data, offsets, known), _styles(data, offsets)]) > 0


def _voting(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.own("toxicity")
        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            votes = []
            for a, b in C.steps(offsets):
                votes += [np.packbits(v).tobytes() for v in _votes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(votes, pa.binary())], names=["toxic", "votes"])
    return run


def _choose(votes: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Voters by what they newly cover of the toxic rows, each row up to three times; votes on clean rows cost."""
    left, chosen = np.full(len(toxic), 3.0) * toxic, []
    clean = votes[~toxic.astype(bool)].sum(0)
    least = max(2.0, 0.003 * toxic.sum())
    positive = votes[toxic.astype(bool)].astype(np.float32)
    room = left[toxic.astype(bool)]
    while len(chosen) < VOTERS:
        gain = np.minimum(room, 1) @ positive - 3.0 * clean
        gain[chosen] = -np.inf
        best = int(np.argmax(gain)) if len(gain) else -1
        if best < 0 or gain[best] < least:
            break
        chosen.append(best)
        room = np.maximum(room - positive[:, best], 0)
    return chosen


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row and the weight of each voter.

    ``start`` are first beliefs, which say which class is the toxic one. The
    human label (``start`` above one half) stays as one more voter; its rates,
    like those of all voters and the share of toxic rows, are estimated from
    agreement in every round, so a label that no voter bears out may lose.
    """
    belief = start.astype(float)
    human = (belief > 0.5).astype(float)
    share = np.ones(votes.shape[1])
    weight = np.zeros(votes.shape[1])

    def rates(voter):
        one, none = belief.sum(), (1 - belief).sum()
        return (belief @ voter + 0.5) / (one + 1), ((1 - belief) @ voter + 0.5) / (none + 1)

    for turn in range(rounds):
        hit, false = rates(votes)
        if turn % 5 == 0:  # correlations: agreement beyond what the rates explain
            rest = votes - belief[:, None] * hit - (1 - belief)[:, None] * false
            spread = np.sqrt((rest ** 2).mean(0)) + 1e-9
            together = np.abs((rest.T @ rest) / len(rest) / np.outer(spread, spread))
            np.fill_diagonal(together, 0)
            share = 1 / (1 + np.where(together > 0.3, together, 0).sum(0))
        weight = share * (np.log(hit / false) - np.log((1 - hit) / (1 - false)))
        base = (share * np.log((1 - hit) / (1 - false))).sum()
        said, wrongly = rates(human)
        own = np.where(human > 0, np.log(said / wrongly), np.log((1 - said) / (1 - wrongly)))
        prior = np.log((belief.sum() + 0.5) / ((1 - belief).sum() + 0.5))
        belief = 1 / (1 + np.exp(-np.clip(prior + own + base + votes @ weight, -30, 30)))
    return belief, weight


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The voters and weights, learnt from labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_ll_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("_ll_id is not null and toxic is not null").where(~held_out(F.col("_ll_id")))
    known = known.groupBy("_ll_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_ll_id"), "_ll_id").limit(SAMPLE)
    # at most SAMPLE pairs of numbers: the bound of this broadcast
    sample = durable(docs.select("doc_id", "text").join(
        F.broadcast(known), F.col("doc_id").cast("long") == F.col("_ll_id")).select("toxic", "text"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positive, total = sizes.get(1, 0), sum(sizes.values())
    model = {"voters": np.zeros(0, np.uint64), "weights": np.zeros(1 + len(_STYLES)), "share": (positive + 0.5) / (total + 1)}
    model["weights"][0] = np.log(model["share"] / (1 - model["share"]))
    if not positive or positive == total:
        return model
    def spread(kind: int, known: np.ndarray | None, name: str) -> DataFrame:
        found = sample.where(F.col("toxic") == kind).select("text").mapInArrow(_features_of(known), "feature long, n long")
        return found.groupBy("feature").agg(F.sum("n").alias(name))

    # a feature of the share s can be one of (features of a document) / s at most
    toxic = durable(spread(1, None, "toxic").where(F.col("toxic") >= max(2, 0.004 * positive)))
    known = np.sort(np.array([r["feature"] for r in toxic.select("feature").collect()], np.int64).view(np.uint64))
    if not len(known):
        return model
    clean = spread(0, known, "clean")
    found = toxic.join(clean, "feature", "left").fillna(0, ["clean"]).where(
        F.col("clean") * (10.0 * positive / (total - positive)) <= F.col("toxic"))
    found = found.orderBy(F.desc("toxic"), "clean", "feature").limit(CANDIDATES).collect()
    candidates = np.sort(np.array([r["feature"] for r in found], np.int64).view(np.uint64))
    rows = sample.select("toxic", "text").mapInArrow(_voting(candidates), "toxic int, votes binary").collect()
    toxic = np.array([r["toxic"] for r in rows])
    votes = np.unpackbits(np.frombuffer(b"".join(bytes(r["votes"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    chosen = sorted(_choose(votes[:, : len(candidates)], toxic))
    voters = candidates[chosen]
    votes = votes[:, [*chosen, *range(len(candidates), len(candidates) + len(_STYLES))]].astype(float)
    belief, _ = label_model(votes, np.where(toxic == 1, 0.95, 0.05))
    return {**model, "voters": voters, "weights": _logistic(votes, belief)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    voters, weights = model["voters"], model["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.own("toxicity")
        for batch in batches:
            found = _scores(batch.column("text"), voters, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scores(column: pa.Array, voters: np.ndarray, weights: np.ndarray) -> np.ndarray:
    data, offsets = C.flat(column)
    found = [np.zeros(0)]
    for a, b in C.steps(offsets):
        part, at = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
        z = weights[0] + _votes(part, at, voters) @ weights[1:]
        found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(found)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """Rows of ``docs`` with a score below one half; all columns stay."""
    voters, weights = model["voters"], model["weights"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.own("toxicity")
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), voters, weights) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
