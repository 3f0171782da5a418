"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most four bits agree in one of them up to one bit, so each is indexed
under its 64 segment variants with one wildcard bit, an equality grouping
brings the candidates together, and every candidate is verified by its
number of differing bits. Equal fingerprints are one node.

A group of candidates is linked by a forest of verified links, not by all its
pairs. Groups of more than ``GROUP`` fingerprints leave the first pass and
are compared in pairs of blocks, each a group of its own.

Null or empty text has fingerprint zero and is linked like any other. Rows
that share an ID or a text give a row each. Rows without an ID get the
component of their fingerprint, named by the smallest ID in it (null if there
is none). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import common as C
from ledgerloom.runtime import durable

WORDS, MAX_BITS, SEED = 4, 4, 42
#: Bits of the segments, and the largest group compared in one piece.
CUTS, GROUP = (22, 21, 21), 20_000

_EDGES = np.cumsum((0, *CUTS))
SEGMENTS = [((1 << int(b)) - (1 << int(a))) for a, b in zip(_EDGES[:-1], _EDGES[1:])]
SEGMENT_OF = [int(np.searchsorted(_EDGES, bit, "right")) - 1 for bit in range(64)]


def _bits(text: bytes) -> int:
    parts = text.translate(C.LOWER.tobytes()).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(parts) > WORDS:
        starts, ends = starts[: 1 - WORDS], ends[WORDS - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), ">u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        some = np.unpackbits(hashes[at: at + 4096].view(np.uint8)).reshape(-1, 64)
        ones += some.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.own("simhash")
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        raw, at = data.tobytes(), offsets.tolist()
        found = np.fromiter((_bits(raw[a:b]) for a, b in zip(at[:-1], at[1:])), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(C.signed(found))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the 64-bit fingerprint ``fp`` (as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _first_bucket(x: np.ndarray) -> np.ndarray:
    """The wildcard bit under which two fingerprints differing by ``x`` are linked; -1 if they are not near."""
    bucket = np.full(x.shape, -1, np.int64)
    for low, mask in zip(_EDGES[:-1][::-1], SEGMENTS[::-1]):
        part = x & np.uint64(mask)
        ones = np.bitwise_count(part)
        bit = np.where(part == 0, int(low), np.bitwise_count(part - np.uint64(1)).astype(np.int64))
        bucket = np.where(ones <= 1, bit, bucket)
    return np.where(np.bitwise_count(x) <= MAX_BITS, bucket, -1)


def _forest(fp: np.ndarray, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the links of one group connect."""
    left, found = np.arange(len(fp)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            node = todo.pop()
            near = _first_bucket(fp[left] ^ fp[node]) == bit
            if near.any():
                reached, left = left[near], left[~near]
                found.append((np.full(len(reached), fp[node]), fp[reached]))
                todo.extend(reached.tolist())
    return found


def _link(key: np.ndarray, bit: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside the groups of equal keys; the rows stand in key order."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    size, found = np.diff(cut), []
    for g in np.flatnonzero(size > 64):
        a, b = cut[g], cut[g + 1]
        found += _forest(fp[a:b], int(bit[a]))
    many = np.repeat(size, size)
    rows, lag = np.flatnonzero((many > 1) & (many <= 64)), 1
    while len(rows):
        rows = rows[rows + lag < len(key)]
        rows = rows[key[rows] == key[rows + lag]]
        near = rows[_first_bucket(fp[rows] ^ fp[rows + lag]) == bit[rows]]
        if len(near):
            found.append((fp[near], fp[near + lag]))
        lag += 1
    return found


def _linker(limit: int | None):
    """Links of each group; the rows of groups beyond ``limit`` come out as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pairs, kind=0, at=None):
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), pa.array(C.signed(a)), pa.array(C.signed(b)),
                 pa.array(np.zeros(len(a), np.int32) if at is None else at.astype(np.int32))], names=["kind", "a", "b", "bit"])

        key, bit, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            bit = np.concatenate([bit, batch.column("bit").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if hot is not None:
                end = int(np.searchsorted(key, hot, "right"))
                yield rows([(key[:end].view(np.uint64), fp[:end])], 1, bit[:end])
                if end == len(key):
                    key, bit, fp = key[end:], bit[end:], fp[end:]
                    continue
                key, bit, fp, last, hot = key[end:], bit[end:], fp[end:], last - end, None
            if last:
                yield rows(_link(key[:last], bit[:last], fp[:last]))
                key, bit, fp = key[last:], bit[last:], fp[last:]
            if limit and len(key) > limit:
                hot = key[0]
                yield rows([(key.view(np.uint64), fp)], 1, bit)
                key, bit, fp = key[:0], bit[:0], fp[:0]
        if len(key):
            yield rows(_link(key, bit, fp))
    return run


def _grouped(keyed: DataFrame, limit: int | None) -> DataFrame:
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return durable(dealt.mapInArrow(_linker(limit), "kind int, a long, b long, bit int"))


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Verified links (a, b) that connect the distinct fingerprints ``fp`` as all links would."""
    masks = F.array(*[F.lit(C.signed(np.array([SEGMENTS[SEGMENT_OF[i]] & ~(1 << i)], np.uint64))[0].item()) for i in range(64)])
    keyed = nodes.select("fp", F.posexplode(masks).alias("bit", "mask")).select(
        F.xxhash64("bit", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "bit", "fp")
    found = _grouped(keyed, group)
    hot = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "bit")
    pairs = found.where("kind = 0").select("a", "b")
    if hot.isEmpty():
        return pairs
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / group).cast("int").alias("blocks"))
    split = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "bit", "fp")
    return pairs.unionByName(_grouped(split, None).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    found = durable(fingerprints(docs))
    nodes = durable(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = C.components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = durable(named.join(lowest, "root").select("fp", "component_id"))
    return found.join(named, "fp")


# --- near copies of texts: similarity of shingle sets ---------------------------

#: Fingerprints of a text's distinct words, words of a shingle, least similarity of the shingle sets.
SEEDS, SHINGLE, SIMILAR = 3, 5, 0.8
#: Keys of the shingle set: each of so many hashes' least values. A pair at 0.8 shares none with a chance of (1 - 0.8^4)^32 = 5e-8.
KEYS, LEAST = 32, 4
#: Least values (of KEYS * LEAST) that two texts must have in common to be candidates. A pair at 0.8 has fewer with a chance of 2e-8.
AGREE = 76
#: Words of a block of candidates that one group takes; a larger block is compared in pairs of its parts.
BLOCK_WORDS = 2_000_000


def _word_hashes(data: np.ndarray) -> np.ndarray:
    data = C.LOWER[data]
    starts, ends, _ = C.words(data, np.array([0, len(data)]))
    return C.span_hash(C.prefix(data), starts, ends)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at: at + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _shingles(hashes: np.ndarray) -> np.ndarray:
    return np.unique(C.mix(C.rolling(hashes, min(SHINGLE, max(1, len(hashes))))))


def _keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for every ``LEAST`` of the least values of the shingles under seeded hashes, and a byte of each least value."""
    seeds = C.mix(np.arange(1, KEYS * LEAST + 1, dtype=np.uint64) * C.U64(0x9E3779B97F4A7C15)) | C.U64(1)
    least = np.full(len(seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(seeds, shingles[at: at + 2048]).min(1), out=least)
    least = C.mix(least)
    return C.mix(C.rolling(least, LEAST)[::LEAST] + np.arange(KEYS, dtype=np.uint64)), least.astype(np.uint8)


def _word_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.own("simhash")
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        sketches = []
        found, count = np.zeros((len(batch), SEEDS), np.uint64), np.zeros(len(batch), np.int64)
        keys = np.zeros((len(batch), KEYS), np.uint64)
        for i in range(len(batch)):
            hashes = _word_hashes(data[offsets[i]: offsets[i + 1]])
            count[i], (keys[i], sketch) = len(hashes), _keys(_shingles(hashes))
            sketches.append(sketch.tobytes())
            hashes = np.unique(hashes)
            found[i] = [_majority(C.mix(hashes ^ C.U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))) for k in range(SEEDS)]
        prints, keys = (
            pa.FixedSizeListArray.from_arrays(pa.array(C.signed(x.ravel())), x.shape[1]).cast(pa.list_(pa.int64())) for x in (found, keys))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_hash"), pa.array(count), prints, keys, pa.array(sketches, pa.binary())],
            names=["id", "text_hash", "words", "prints", "keys", "sketch"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.own("simhash")
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        for low, high in C.steps(offsets, 4 * C.CHUNK):  # sets are larger than texts
            sets = [_shingles(_word_hashes(data[a:b])).tobytes() for a, b in zip(offsets[low:high], offsets[low + 1: high + 1])]
            names = ["block", "parts", "id"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).slice(low, high - low) for n in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _verified(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of at least ``SIMILAR`` that connect the sets as all such pairs do.

    A set leaves ``left`` over a verified pair only, and is then compared with
    all that are left. Two sets that similar share one of the ``prefix`` rarest
    items of each, so sets that share none of them need no comparison.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start, none = np.cumsum(size) - size, np.flatnonzero(size == 0)
    found = [(np.full(len(none) - 1, none[0]), none[1:])] if len(none) > 1 else []
    _, items, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    rank = np.empty_like(order)
    rank[order], count = np.arange(len(order)), count[order]
    owner = np.repeat(np.arange(len(sets)), size)
    items = np.sort(owner * len(count) + rank[items]) - owner * len(count)  # in each set the rarest come first
    prefix = size - np.ceil(SIMILAR * size - 1e-6).astype(np.int64) + 1
    rare = np.flatnonzero((np.arange(len(items)) - start[owner] < prefix[owner]) & (count[items] > 1))
    own, low = items[rare], np.searchsorted(owner[rare], np.arange(len(sets) + 1))
    by = np.argsort(own, kind="stable")
    what, who = own[by], owner[rare][by]
    left, marked = size > 0, np.zeros(len(count), bool)
    indexed = int(left.sum())
    for first in range(len(sets)):
        todo, left[first] = [first] if left[first] else [], False
        while todo:
            node = todo.pop()
            mine = own[low[node]: low[node + 1]]
            begin = np.searchsorted(what, mine)
            near = who[_ranges(begin, np.searchsorted(what, mine, "right") - begin)]
            near = np.unique(near[left[near]])
            if not len(near):
                continue
            mine = items[start[node]: start[node] + size[node]]
            marked[mine] = True
            ends = np.cumsum(size[near])
            for a, b in C.steps(np.r_[0, ends]):
                some = near[a:b]
                both = np.add.reduceat(marked[items[_ranges(start[some], size[some])]], np.cumsum(size[some]) - size[some], dtype=np.int64)
                some = some[both >= SIMILAR * (size[some] + size[node] - both)]
                left[some] = False
                found.append((np.full(len(some), node), some))
                todo.extend(some.tolist())
            marked[mine] = False
            if 2 * (now := int(left.sum())) < indexed:
                stays = left[who]
                what, who, indexed = what[stays], who[stays], now
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links inside the groups of equal keys; the rows stand in key order."""
    C.own("simhash")
    key, ids, sets = None, [], []

    def links():
        a, b = _verified(sets) if len(sets) > 1 else (np.zeros(0, np.int64),) * 2
        named = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(named[a]), pa.array(named[b])], names=["a", "b"])

    for batch in batches:
        for k, i, s in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("shingles").to_pylist()):
            if k != key:
                if len(sets) > 1:
                    yield links()
                key, ids, sets = k, [], []
            ids.append(i)
            sets.append(np.frombuffer(s, np.uint64))
    yield links()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the texts of each group of equal keys as all pairs with ``AGREE`` common least values do."""
    def links(ids: list, sketches: list) -> tuple[np.ndarray, np.ndarray]:
        ids, sketches = np.array(ids, np.int64), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), -1)
        left, a, b = np.arange(len(ids)), [], []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                node = todo.pop()
                near = np.count_nonzero(sketches[left] == sketches[node], axis=1) >= AGREE
                reached, left = left[near], left[~near]
                a.append(np.full(len(reached), ids[node]))
                b.append(ids[reached])
                todo.extend(reached.tolist())
        return np.concatenate([*a, ids[:0]]), np.concatenate([*b, ids[:0]])

    key, ids, sketches = None, [], []
    for batch in batches:
        found = []
        for k, i, s in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "sketch"))):
            if k != key:
                if len(ids) > 1:
                    found.append(links(ids, sketches))
                key, ids, sketches = k, [], []
            ids.append(i)
            sketches.append(s)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found)], names=["a", "b"])
    if len(ids) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(side) for side in links(ids, sketches)], names=["a", "b"])


def _key_links(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between texts that share a key and have ``AGREE`` least values in common.

    Keys shared by the same texts are one bucket. Buckets of more than
    ``group`` texts are compared in pairs of parts.
    """
    keyed = durable(texts.select("id", "text_hash", F.explode("keys").alias("key")))
    members = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("text_hash")).alias("x"), F.bit_xor(F.xxhash64("text_hash", F.lit(1))).alias("y"))
    buckets = members.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select(
        "key", F.when(F.col("n") > group, F.ceil(2 * F.col("n") / group)).otherwise(1).cast("int").alias("parts"))
    rows = keyed.join(buckets, "key").withColumn("own", F.pmod(F.xxhash64("text_hash"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "text_hash")
    rows = rows.join(texts.select("text_hash", "id", "sketch"), "text_hash").select("key", "id", "sketch")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_alike, "a long, b long")


def _candidates(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of IDs that connect all texts with a near or equal fingerprint, or an equal key and alike least values."""
    pairs = _key_links(texts, group)
    for k in range(SEEDS):
        named = texts.select("id", F.col("prints")[k].alias("fp"))
        heads = durable(named.groupBy("fp").agg(F.min("id").alias("head"), F.count("*").alias("n")))
        near = links(heads.select("fp"))
        found = (
            near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a")
            .join(heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b")
            .select(F.col("ha").alias("a"), F.col("hb").alias("b"))
            .unionByName(named.join(heads.where("n > 1"), "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))))
        pairs = pairs.unionByName(found)
    return pairs


def near_texts(docs: DataFrame, limit: int = BLOCK_WORDS, group: int = GROUP) -> DataFrame:
    """id, text_hash, root of every row: texts of at least ``SIMILAR`` shingle sets share the root, the smallest ID.

    A fingerprint of the distinct words moves less under scattered edits than
    one of shingles, so texts are candidates by some of them, with differing
    seeds. A block of other text moves them too far, so the least hashes of the
    shingles find candidates too: any pair at ``SIMILAR`` shares a key of them.
    A pair far below it often does as well, so texts that share a key must also
    have ``AGREE`` least values in common before they are connected; shared
    boilerplate therefore does not join texts that are otherwise unlike.
    Whatever candidates connect is one block; inside it every text meets every
    other, and only pairs verified by their shingle sets link.
    A block of more than ``limit`` words is dealt into parts, and each pair of
    parts is a group of its own. Equal texts need no search.
    """
    slim = docs.select(C.doc_key(F.col("doc_id"), F.col("text")).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = durable(slim.mapInArrow(_word_prints, "id long, text_hash long, words long, prints array<long>, keys array<long>, sketch binary"))
    texts = durable(rows.groupBy("text_hash").agg(F.min(F.struct("id", "words", "prints", "keys", "sketch")).alias("low")).select("text_hash", "low.*"))
    blocks = C.components(_candidates(texts, group)).select(F.col("node").alias("id"), F.col("root").alias("block"))
    wanted = durable(texts.select("id", "words", F.col("text_hash").alias("h")).join(blocks, "id"))
    large = wanted.groupBy("block").agg(F.ceil(2 * F.sum("words") / limit).cast("int").alias("parts")).where("parts > 2")
    wanted = wanted.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sets = slim.join(wanted, "id").where("text_hash = h").select("block", "parts", "id", "text").mapInArrow(
        _shingle_sets, "block long, parts int, id long, shingles binary")
    split = sets.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "shingles")
    keyed = split.repartition("key").sortWithinPartitions("key", "id")
    roots = C.components(durable(keyed.mapInArrow(_set_links, "a long, b long")))
    named = texts.join(roots.withColumnRenamed("node", "id"), "id", "left").select("text_hash", F.coalesce("root", "id").alias("root"))
    return rows.select("id", "text_hash").join(named, "text_hash")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``near_texts``: that of its smallest ID; all columns stay.

    Of rows that share an ID one stays. A row without an ID can stay; it comes
    after all others.
    """
    names = docs.columns
    chosen = durable(near_texts(docs).where("id = root").groupBy(F.col("id").alias("_ll_id")).agg(F.min("text_hash").alias("_ll_text")))
    keyed = docs.withColumn("_ll_id", C.doc_key(F.col("doc_id"), F.col("text"))).withColumn("_ll_hash", F.xxhash64("text"))
    once = Window.partitionBy("_ll_id").orderBy("_ll_hash")
    return (
        keyed.join(chosen, "_ll_id").where("_ll_hash = _ll_text")
        .withColumn("_ll_rank", F.row_number().over(once)).where("_ll_rank = 1").select(*names))
