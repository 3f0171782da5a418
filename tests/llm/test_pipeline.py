import collections
import functools
import random
import re
import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import common, toxicity
from tests.llm.conftest import SF, lower
from tests.llm.test_operators import BPE, base_rules, brute_passages, shingle_set


def test_stages(spark, tmp_path):
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    assert all(not base_rules(r["text"])[-1] for r in kept[0].select("text").collect())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert {r["doc_id"] for r in kept[4].select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept[3].select("doc_id").collect()}


def test_run_equals_its_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and "sequence_id" in found.columns


# --- run() against plain Python stages -----------------------------------------

def plain_quality(rows):
    failed = {i: base_rules(t)[-1] for i, t, _ in rows}
    hosts = collections.defaultdict(lambda: [0, 0])
    for i, _, source in rows:
        if source is not None:
            hosts[source][0] += 1
            hosts[source][1] += failed[i]
    n, f = (sum(h[x] for h in hosts.values()) for x in (0, 1))
    mean = (f + 0.5) / (n + 1)
    chance = mean * (1 - mean)
    between = max(0.0, sum(b * b / a for a, b in hosts.values()) - f * f / n)
    room = n - sum(a * a for a, _ in hosts.values()) / n
    spread = (between - (len(hosts) - 1) * chance) / room if room > 0 else 0.0
    strength = max(1.0, chance / spread - 1) if spread > chance * 1e-6 else 1e6
    bad = {s for s, (a, b) in hosts.items() if (b + mean * strength) / (a + strength) > 0.5}
    return [r for r in rows if not failed[r[0]] and r[2] not in bad]


def plain_votes(model, rows):
    word = re.compile(r"[a-z0-9'\x80-\U0010ffff]+")
    weights, voters = model["weights"], {int(v): i for i, v in enumerate(model["voters"])}

    @functools.cache
    def heard(one):
        raw = np.frombuffer(one, np.uint8)
        size = np.arange(1, len(raw) + 1)
        hashes = common.span_hash(common.prefix(raw), np.zeros_like(size), size)
        keys = [int(hashes[-1]), *(hashes + size.astype(np.uint64)).tolist()]
        return frozenset(voters[k] for k in keys if k in voters)

    for row in rows:
        text = lower(row[1])
        heard_here = set().union(*(heard(w.encode()) for w in set(word.findall(text))))
        votes = [i in heard_here for i in range(len(voters))] + [mark in text for mark in ("!!", "??", "**", "?!", "@#")]
        score = 1 / (1 + np.exp(-(weights[0] + weights[1:] @ np.array(votes, float))))
        assert abs(score - 0.5) > 1e-6
        if score < 0.5:
            yield row


def plain_near_copies(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [r for r in rows if find(r[0]) == r[0]]


def test_run_equals_plain_stages(spark, tmp_path):
    """Rows of ``run`` on the smallest tables with planted copies, edits, passages, nulls, junk and toxic texts."""
    draw = random.Random(17)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = lambda n: " ".join(f"{draw.choice('bcdfgk')}{draw.randint(0, 3000)}" for _ in range(n))
    passage, rows = prose(70), []
    for group in range(12):
        text = prose(draw.randint(120, 300))
        parts = text.split(" ")
        n = len(parts)
        rows += [text, text, " ".join(parts[: n - n // 8]), text + " " + prose(n // 7), " ".join(parts[: n // 2]),
                 " ".join(parts[:-3] + ["other"] * 3), prose(60) + " " + passage + " " + prose(60)]
    rows += [None, "", "too short", "again and " * 60, prose(9_000)]
    own = spark.createDataFrame(
        [(1_000_000 + i, t, None if t is None else len(t), f"planted{i % 5}" if i % 3 else None) for i, t in enumerate(rows)],
        "doc_id long, text string, n_chars long, source string")
    own = own.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2_000_000), allowMissingColumns=True)
    folder = str(tmp_path / "tables")
    docs.unionByName(own.select([F.col(c).cast(docs.schema[c].dataType).alias(c) if c in own.columns else F.lit(None).alias(c)
                                 for c in docs.columns])).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")

    left = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    sizes = [len(left)]
    left = plain_quality(left)
    sizes.append(len(left))
    ids = [r[0] for r in left]
    kept = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id").isin(ids))
    model = toxicity.train(kept, spark.read.parquet(f"{folder}/labels.parquet"))
    left = list(plain_votes(model, left))
    sizes.append(len(left))
    left = plain_near_copies(left)
    sizes.append(len(left))
    cut = brute_passages([(i, i, t) for i, t, _ in left])
    texts = {i: cut[i][2] if cut[i][1] else t for i, t, _ in left}
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and any(c[1] for c in cut.values())

    tokens = Tokenizer.from_file(BPE)
    want = {i: np.array(tokens.encode(t, add_special_tokens=False).ids + [1], np.uint32) for i, t in texts.items()}
    found, sequences = collections.defaultdict(int), collections.defaultdict(int)
    for p in corpus_pipeline.run(spark, folder).collect():
        piece = want[p["doc_id"]][p["start"]: p["start"] + p["length"]]
        assert p["doc_tokens"] == len(want[p["doc_id"]]) and len(piece) == p["length"]
        assert zlib.crc32(piece.tobytes()) == p["ids_crc32"]
        found[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]] += p["length"]
    assert found == {i: len(v) for i, v in want.items()}
    assert max(sequences.values()) <= 2048
