"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import prefix_trie
from ledgerloom.llm.prefix_trie import ALIAS, NODE, REST, ROOT, Element, Forest, common
from tests.llm.conftest import SF


def rebuild(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def plain(talks):
    """Every prefix with its members."""
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    low = {k: min(v) for k, v in nodes.items()}
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (low[k], len(k), low[k[:-1]] if k else -1, len(v), len(kids.get(k, [])), leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(v) if len(talks[c]) == len(k)).encode()).hexdigest())
        for k, v in nodes.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def drawn(seed, size, letters, longest):
    draw = random.Random(seed)
    talks = []
    for _ in range(size):
        if talks and draw.random() < 0.5:
            old = draw.choice(talks)
            talks.append(old[: draw.randint(0, len(old))] + [draw.randrange(letters) for _ in range(draw.randint(0, 3))])
        else:
            talks.append([draw.randrange(letters) for _ in range(draw.randint(0, longest))])
    return {i * 3 + 1: [("r", "x" * t) for t in v] for i, v in enumerate(talks)}


def test_forest_of_small_stretches():
    """Contracted batches and tasks give the nodes of one union-find, wherever the borders lie."""
    draw = random.Random(4)
    for seed in range(300):
        talks = drawn(seed, draw.randint(1, 14), draw.randint(1, 3), 5)
        classes = {}
        for c, turns in talks.items():
            classes.setdefault(tuple(turns), []).append(c)
        mark = lambda t: hashlib.md5(repr(t).encode()).digest()
        entries = sorted((b"".join(map(mark, k)), k, v) for k, v in classes.items())

        def element(k, v):
            cum = [sum(len(t[1]) for t in k[:i]) for i in range(len(k) + 1)]
            return Element(g=0, low=min(v), hi=len(k), n=len(v), kids=0, leaves=1, below=0, deep=cum[-1], acc=0, cum=cum, ender=min(v))

        def pieces(rows):
            while rows:
                n = draw.randint(1, 4)
                yield rows[:n]
                rows = rows[n:]

        out, rest, part = [], [], 0
        for task in pieces(entries):
            forest = Forest(0, part, True)
            for batch in pieces(task):
                forest.add([element(k, v) for _, k, v in batch], [common(a[0], b[0]) for a, b in zip(batch, batch[1:])],
                           (0, batch[0][0]), (0, batch[-1][0]))
            forest.rest()
            out += [r for r in forest.out if r["kind"] != REST]
            rest.append([r for r in forest.out if r["kind"] == REST])
            part += 1
        last = Forest(0, 1 << 30, False)
        for rows in rest:
            last.add([Element(**{n: r[n] for n in Element.__slots__}) for r in rows], [r["edge"] for r in rows[:-1]],
                     (0, rows[0]["head"]), (0, rows[-1]["tail"]))
        last.close()
        out += last.out
        names = {r["uid"]: r["parent"] for r in out if r["kind"] == ALIAS}
        have = []
        for r in out:
            if r["kind"] == NODE:
                above = r["parent"] if r["uid"] is None else names[r["uid"]]
                points = [len(t[1]) for t in talks[r["low"]]]
                for d in range(r["lo"] + 1, r["hi"] + 1):
                    have.append((r["low"], d, above if d == r["lo"] + 1 else r["low"], r["n"], r["kids"] if d == r["hi"] else 1,
                                 r["leaves"], r["below"] + (r["n"] - 1) * (r["deep"] - sum(points[: d - 1]))))
            elif r["kind"] == ROOT:
                have.append((r["low"], 0, -1, r["n"], r["kids"], r["leaves"], r["acc"]))
        assert sorted(have) == [r[:-1] for r in plain(talks)]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_nodes(spark, block):
    """Blocks of any size, batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        talks = drawn(block, 60, 2, 7)
        rows = [(c, i, hashlib.md5(repr(t).encode()).hexdigest(), len(t[1])) for c, v in talks.items() for i, t in enumerate(v)]
        rows += [(c, len(v), "", 0) for c, v in talks.items()]
        df = spark.createDataFrame(rows, "conv long, pos long, mark string, points long")
        assert got(prefix_trie.nodes(df, block)) == plain(talks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_table(spark):
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.trie(talks)) == plain(rebuild(rows))


def test_tricky(spark):
    draw = random.Random(8)
    rows = []
    for c in [*range(0, 12), 100, 101, 102, 103, 205, 206, 333, 400, 401]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, t if t else None, draw.choice(["user", None, ""]), draw.choice(["", None, "a", "ä🙂", "long " * 2000])))
    rows += [(None, 1, "user", "nobody"), (102, 50, "user", "again"), (102, 50, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for name in ("conv", "pos", "mark", "g", "key", "rank", "low"):
        df = df.withColumn(name, F.lit("extra"))
    assert got(prefix_trie.trie(df)) == plain(rebuild(rows))
    assert prefix_trie.trie(df.limit(0)).collect() == []


def test_many_copies(spark):
    """A third of all conversations are one, another third share their first turn."""
    rows = [(i, t, "user", f"same {t}") for i in range(0, 1200) for t in range(4)]
    rows += [(i, t, "user", f"same {t}" if t == 0 else f"own {i} {t}") for i in range(1200, 2400) for t in range(3)]
    rows += [(i, t, "user", f"own {i} {t}") for i in range(2400, 3600) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(8)
    assert got(prefix_trie.trie(df)) == plain(rebuild(rows))


def test_one_huge_conversation(spark):
    """A third of all turns in one conversation goes over many blocks."""
    rows = [(1, t, "user", f"turn {t % 50}") for t in range(300)] + [(500 + i, t, "user", f"turn {t}") for i in range(75) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert got(prefix_trie.trie(df, 16)) == plain(rebuild(rows))
