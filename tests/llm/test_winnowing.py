"""Decontamination against a plain search for every window of every item."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ordered, winnowing
from tests.llm.conftest import SF, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(lower(text))


def judge(docs, items):
    """Counts of each document, by a table of all windows."""
    table = {}
    for item, text in items:
        w = tokens(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            table.setdefault(tuple(w[i:i + size]), set()).add(str(item) if item is not None else "")
    sizes = {len(k) for k in table}
    out = []
    for doc, text in docs:
        w, hit, found = tokens(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = table.get(tuple(w[i:i + size]))
                if got:
                    found |= got
                    hit |= set(range(i, i + size))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def compare(docs, items):
    got = winnowing.contamination(docs, items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = judge([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()],
                 [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    return want


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_tables(documents, benchmark):
    want = compare(documents, benchmark)
    assert any("True" in w for w in want)


def test_tricky(spark, tricky):
    some = [r["text"] for r in tricky.where("doc_id IN (6, 7, 5, 14, 16)").collect()]
    items = [(i, " ".join(t.split()[3:20])) for i, t in enumerate(some)] + [(i, " ".join(t.split()[5:30])) for i, t in enumerate(some)]
    items += [(50 + i, t) for i, t in enumerate([
        None, "", "...", "tick", "TICK-tock", "1234", "Straße", "same line same line same line", "x", "never there", some[0]])]
    items += [(None, "same line"), (None, "Große"), (7, "12"), (7, "5")]
    compare(tricky, spark.createDataFrame(items, "item_id long, text string"))


def test_random_words(spark):
    draw = random.Random(5)
    for letters in (2, 4, 40):
        text = lambda n: " ".join(str(draw.randrange(letters)) for _ in range(n))
        docs = [(i, text(draw.randint(0, 60))) for i in range(60)]
        items = [(i, text(draw.choice([3, 5, 8, 9, 10, 11, 14, 30]))) for i in range(20)]
        items += [(100 + i, " ".join((t or "").split()[2:2 + draw.randint(4, 25)])) for i, (_, t) in enumerate(docs[::6])]
        compare(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_empty(spark, documents, empty, benchmark):
    assert winnowing.contamination(empty, benchmark).count() == 0
    none = winnowing.contamination(documents.limit(20), benchmark.limit(0)).collect()
    assert len(none) == 20 and not any(r["contaminated"] for r in none)


def test_shared_span_is_always_marked():
    """Any ten equal words have the same fingerprint, whatever stands around them."""
    draw = np.random.default_rng(1)
    for _ in range(300):
        a, b, span = (draw.integers(0, 2**62, n).astype(np.uint64) for n in (30, 17, 10))
        x, y = np.concatenate([a, span, b]), np.concatenate([b, span, a])
        one, _ = winnowing.marks(x, np.zeros(len(x), np.int64), 10)
        two, _ = winnowing.marks(y, np.zeros(len(y), np.int64), 10)
        assert one[30] == two[17]


def test_clean(spark, tricky, benchmark):
    item = spark.createDataFrame([(1, "tick tock tick"), (2, "same")], "item_id long, text string")
    left = winnowing.clean(tricky, item)
    assert left.columns == tricky.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(
        str(r["doc_id"]) for r in tricky.collect() if r["doc_id"] not in (11, 16))
    assert winnowing.clean(tricky, item, 0.9).where("doc_id = 11").count() == 1


def test_ordered_digests(spark, monkeypatch):
    """A group over many pieces and tasks."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
                                      F.col("id").cast("string").alias("member"), "id")
    want = {}
    for r in rows.collect():
        want.setdefault(r["key"], []).append(r["id"])
    got = {r["key"]: (r["n"], r["sha"]) for r in ordered.digests(rows, "id").collect()}
    assert got == {k: (len(v), hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for k, v in want.items()}
