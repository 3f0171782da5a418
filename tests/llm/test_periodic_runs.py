"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import periodic_runs
from tests.llm.conftest import words


def plain_runs(w):
    """For every period the maximal stretches of equal words; of one stretch only its smallest period counts."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def rewritten(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def digest(doc_id, text):
    w = rewritten(doc_id, words(text))
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_small_alphabets(letters):
    draw = random.Random(letters)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 4)):
            w = [draw.randrange(letters) for _ in range(draw.randint(0, 30))]
            if draw.random() < 0.7:
                block = [draw.randrange(3) for _ in range(draw.randint(1, 5))]
                w += block * draw.randint(1, 8) + block[: draw.randint(0, len(block))] + w[:5]
            texts.append(w)
        before = np.cumsum([0, *map(len, texts)])
        doc, start, length, period = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), before)
        got = sorted(zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()))
        assert got == [(i, *r) for i, w in enumerate(texts) for r in plain_runs(w)]


def test_digests(documents, tricky):
    for docs in (documents, tricky):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        rows = [r for r in rows if len(words(r[1])) < 4000]
        kept = docs.where("length(text) < 1000000 OR text IS NULL")
        got = [tuple(r) for r in periodic_runs.digests(kept).collect()]
        assert len(got) == docs.count()
        have = sorted(map(repr, got))
        for row in rows:
            assert repr(digest(*row)) in have


def test_outputs(spark, tricky, empty):
    assert periodic_runs.digests(empty).collect() == []
    text = "a b " * 5 + "end"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "no repeats\there", "z")], "doc_id long, text string, start string")
    assert [tuple(r) for r in periodic_runs.runs(docs).collect()] == [(1, 0, 10, 2)]
    assert [tuple(r) for r in periodic_runs.collapse(docs).orderBy("doc_id").collect()] == [
        (1, "a b end", "x"), (2, None, "y"), (3, "no repeats\there", "z")]
    assert periodic_runs.collapse(tricky).count() == tricky.count()


def test_long_repetition():
    """One word, and one sequence, repeated 200,000 times: sets grow at their end."""
    for block in ([7], [1, 2, 3]):
        codes = np.array(block * 200_000, np.int64)
        found = periodic_runs.runs_of(codes, np.array([0, len(codes)]))
        assert [x.tolist() for x in found] == [[0], [0], [len(codes)], [len(block)]]


def test_equally_good_runs():
    codes = np.array([1] * 8 + [2] + [3] * 8 + [4, 5, 4, 5, 4, 5, 4, 5], np.int64)
    found = periodic_runs.runs_of(codes, np.array([0, len(codes)]))
    assert periodic_runs._best(1, found)[1].tolist() == [0] and found[1][0] == 0
