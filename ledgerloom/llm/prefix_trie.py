"""The trie of conversation prefixes, from neighbours in sorted order.

Conversations are sequences of turns, a turn is the digest of its role and
text (16 bytes of SHA-256). Equal sequences are one class, so copies count but
are not sorted. Sorted neighbours are joined by an edge whose weight is their
common prefix, in turns. A union-find takes the edges in descending depth:
all components joined at one depth become the children of a branching node.

No task sees all edges. Each batch of a range-partitioned, sorted table gives
a forest. A component whose depth is above the next edge on both sides is
finished; of the others, only the two spines towards the ends of the stretch
are left (depths fall to the stretch's lowest edge, then rise), with siblings
below one unfinished node contracted to one element. Contracted stretches are
joined by the edge between them and go through the same union-find again:
first within a task, then the tasks' results in one last task. That one gets
at most ``4 * BLOCK`` elements a task, whatever the number of conversations.

A node that only its parents' members pass is not an element of its own: an
element stands for the depths between two branchings, and rows by depth are
made at the end by a join of the element's smallest conversation and block.

Sequences are compared in blocks of ``BLOCK`` turns, so that no row holds more
than a block. Only classes that share a whole block with another are sorted
again by the next one; forests of deeper blocks are built first and their
roots hand sums to the block above. Turns are numbered by ranked ranges, so a
conversation with a third of all rows is not one task's.

Defined results: null roles and texts are empty; rows without conv_id belong
to no conversation. Rows of one conversation and turn stand by role, then by
the turn's digest; repeated rows are turns each. Empty and very long texts
count by their code points. Conversations without turns after rebuilding are
members of the root. A table without conversations has no nodes. Of further
columns, whatever their names, none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import ordered
from ledgerloom.llm.periodic_runs import decimal_crc
from ledgerloom.operators.ranks import ranked
from ledgerloom.runtime import durable

#: Turns of a sequence that are one row.
BLOCK = 1024
#: Bytes of a turn's digest.
MARK = 16
#: Conversations are rebuilt on the start of the first of so many.
FAMILY, MOST_HEAD = 100, 5

NODE, ALIAS, ROOT, REST = range(4)
_FIELDS = [
    ("kind", pa.int32()), ("low", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()),
    ("leaves", pa.int64()), ("below", pa.int64()), ("deep", pa.int64()), ("parent", pa.int64()), ("uid", pa.int64()),
    ("ender", pa.int64()), ("g", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("edge", pa.int64()), ("acc", pa.int64()),
    ("cum", pa.list_(pa.int64())), ("head", pa.binary()), ("tail", pa.binary()), ("uids", pa.list_(pa.int64()))]
_NAMES = [name for name, _ in _FIELDS]
_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
_SCHEMA = ", ".join(f"{name} {_SPARK.get(kind, 'array<bigint>')}" for name, kind in _FIELDS)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from their start."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // MARK
    if size <= 16 * MARK:
        return next(i for i in range(0, size, MARK) if a[i: i + MARK] != b[i: i + MARK]) // MARK
    return int(np.argmax(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))) // MARK


class Element:
    """A component, finished down from its top at depth ``hi``; with ``uids``, siblings below an unfinished node at ``hi``."""

    __slots__ = ("g", "low", "hi", "n", "kids", "leaves", "below", "deep", "acc", "cum", "ender", "uids")

    def __init__(self, **values):
        for name in self.__slots__:
            setattr(self, name, values.get(name))


class Forest:
    """Union-find over the edges of a growing stretch of elements. ``base`` turns are shared by all of a group."""

    def __init__(self, base: int, part: int, left_open: bool):
        self.base, self.part, self.left_open = base, part, left_open
        self.items: list[Element] = []
        self.edges: list[int] = []
        self.tail: tuple | None = None
        self.head: tuple | None = None
        self.out: list[dict] = []
        self.made = 0

    def add(self, items: list[Element], edges: list[int], head: tuple, tail: tuple) -> None:
        """Elements to the right, the edges between them, and group and key of the first and the last."""
        if self.items:
            self.edges.append(common(self.tail[1], head[1]) if self.tail[0] == head[0] else -1)
        else:
            self.head = head
        self.items += items
        self.edges += edges
        self.tail = tail
        self.contract(True)

    def close(self) -> None:
        if self.items:
            self.contract(False)

    def rest(self) -> None:
        """What is not finished, as rows."""
        last = len(self.items) - 1
        for i, e in enumerate(self.items):
            self.out.append({
                "kind": REST, "part": self.part, "seq": i, "edge": self.edges[i] if i < last else None, "g": e.g, "low": e.low,
                "hi": e.hi, "n": e.n, "kids": e.kids, "leaves": e.leaves, "below": e.below, "deep": e.deep, "acc": e.acc,
                "cum": e.cum, "ender": e.ender, "uids": e.uids, "head": self.head[1] if i == 0 else None,
                "tail": self.tail[1] if i == last else None})

    def _join(self, members: list[Element], depth: int, parent: int | None, uid: int | None) -> Element:
        """The node at ``depth`` over ``members``. Their own rows name its smallest conversation, or its number."""
        at = depth - self.base
        node = Element(g=members[0].g, low=min(m.low for m in members), hi=depth, n=0, kids=0, leaves=0, acc=0, uids=None)
        named = node.low if parent is None and uid is None else parent
        for m in members:
            node.n += m.n
            if m.uids is not None:
                node.kids, node.leaves, node.acc = node.kids + m.kids, node.leaves + m.leaves, node.acc + m.acc
                node.ender = m.ender if node.ender is None else node.ender
                if uid is None:
                    self.out += [{"kind": ALIAS, "uid": u, "parent": named} for u in m.uids]
                continue
            node.cum = m.cum
            if m.hi == depth:
                node.ender = m.ender
                continue
            self.out.append({
                "kind": NODE, "low": m.low, "lo": depth, "hi": m.hi, "n": m.n, "kids": m.kids, "leaves": m.leaves,
                "below": m.below, "deep": m.deep, "parent": named, "uid": uid, "ender": m.ender})
            node.kids += 1
            node.leaves += m.leaves
            node.acc += m.acc + (m.n - 1) * (m.cum[-1] - m.cum[at])
        if node.cum is not None:
            node.cum = node.cum[: at + 1]
            node.deep = node.cum[-1]
        node.below = node.acc
        return node

    def _siblings(self, members: list[Element], depth: int) -> Element:
        """Neighbours below one node that is not finished, as one element."""
        if len(members) == 1 and members[0].uids is not None:
            return members[0]
        uid = (self.part << 32) + self.made
        self.made += 1
        node = self._join(members, depth, None, uid)
        node.uids = [uid, *(u for m in members if m.uids is not None for u in m.uids)]
        return node

    def contract(self, right_open: bool) -> None:
        items, edges, count = self.items, self.edges, len(self.items)
        root = list(range(count))
        left_shut, right_shut = [False] * count, [False] * count
        left_shut[0], right_shut[-1] = self.left_open, right_open

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        order = sorted(range(count - 1), key=lambda i: -edges[i])
        i = 0
        while i < len(order) and edges[order[i]] >= 0:
            depth, places = edges[order[i]], []
            while i < len(order) and edges[order[i]] == depth:
                places.append(order[i])
                i += 1
            k = 0
            while k < len(places):
                run = [find(places[k])]
                while k < len(places) and find(places[k]) == run[-1]:
                    run.append(find(places[k] + 1))
                    k += 1
                if left_shut[run[0]] or right_shut[run[-1]]:
                    for member in run[:-1]:
                        right_shut[member] = True
                    for member in run[1:]:
                        left_shut[member] = True
                    inner = run[1:-1]
                    if inner:
                        items[inner[0]] = self._siblings([items[m] for m in inner], self.base + depth)
                        for member in inner[1:]:
                            root[member] = inner[0]
                elif depth:
                    items[run[0]] = self._join([items[m] for m in run], self.base + depth, None, None)
                    for member in run[1:]:
                        root[member] = run[0]
        self._sweep([x for x in range(count) if root[x] == x], find, right_open)

    def _sweep(self, places: list[int], find, right_open: bool) -> None:
        """Finishes whole groups and keeps what is left of the others."""
        groups, bounds = [[places[0]]], []
        for x in places[1:]:
            edge = self.edges[x - 1]
            if edge < 0:
                groups.append([x])
            else:
                groups[-1].append(x)
        items, edges, first_of = [], [], []
        for number, group in enumerate(groups):
            members = [self.items[x] for x in group]
            if not (number == 0 and self.left_open) and not (number == len(groups) - 1 and right_open):
                top = self._join(members, self.base, None, None)
                self.out.append({
                    "kind": ROOT, "g": top.g, "low": top.low, "hi": self.base, "n": top.n, "kids": top.kids,
                    "leaves": top.leaves if top.kids else 1, "acc": top.acc, "ender": top.ender})
                continue
            if items:
                edges.append(-1)
            items += members
            edges += [self.edges[x - 1] for x in group[1:]]
        self.items, self.edges = items, edges

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(name) for r in rows], kind) for name, kind in _FIELDS], names=_NAMES)


def _forests(base: int):
    """A forest for the sorted entries of each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(base, TaskContext.get().partitionId(), True)
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            items, edges, before = [], [], None
            for r in rows:
                cum = [r["before"], *(r["before"] + np.cumsum(r["points"])).tolist()] if r["points"] else [r["before"]]
                items.append(Element(
                    g=r["g"], low=r["low"], hi=r["hi"], n=r["n"], kids=r["kids"], leaves=r["leaves"], below=r["below"],
                    deep=r["deep"], acc=r["acc"], cum=cum, ender=r["ender"]))
                if before is not None:
                    edges.append(common(before[1], r["key"]) if before[0] == r["g"] else -1)
                before = (r["g"], r["key"])
            forest.add(items, edges, (rows[0]["g"], rows[0]["key"]), before)
            yield forest.drain()
        forest.rest()
        yield forest.drain()
    return run


def _merged(base: int):
    """One forest from what the partitions left, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, items, edges, head = Forest(base, 1 << 30, False), [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                e = Element(**{name: r[name] for name in Element.__slots__})
                if r["head"] is not None:
                    head = (e.g, r["head"])
                items.append(e)
                if r["tail"] is None:
                    edges.append(r["edge"])
                    continue
                forest.add(items, edges, head, (e.g, r["tail"]))
                items, edges = [], []
            yield forest.drain()
        forest.close()
        yield forest.drain()
    return run


def _forest(entries: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Elements (low, lo, hi, n, kids, leaves, below, deep, parent, ender) and roots by group, of one level."""
    sorted_ = entries.repartitionByRange("g", "key").sortWithinPartitions("g", "key")
    parts = durable(sorted_.mapInArrow(_forests(base), _SCHEMA))
    rest = parts.where(f"kind = {REST}").coalesce(1).sortWithinPartitions("part", "seq")
    last = durable(rest.mapInArrow(_merged(base), _SCHEMA))
    both = parts.where(f"kind <> {REST}").unionByName(last)
    columns = ["low", "lo", "hi", "n", "kids", "leaves", "below", "deep", "parent", "ender"]
    nodes = both.where(f"kind = {NODE}")
    alias = both.where(f"kind = {ALIAS}").select("uid", F.col("parent").alias("named"))
    waiting = nodes.where("uid IS NOT NULL").drop("parent").join(alias, "uid").withColumnRenamed("named", "parent")
    return nodes.where("uid IS NULL").select(*columns).unionByName(waiting.select(*columns)), both.where(f"kind = {ROOT}")


def turns(talks: DataFrame) -> DataFrame:
    """conv, pos (from 0), mark (hexadecimal) and code points of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = talks.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * MARK).alias("mark"),
        F.length(text).cast("long").alias("points"))
    return ranked(slim, ["conv"], ["turn", "role", "mark"]).select(
        "conv", (F.col("rank") - 1).cast("long").alias("pos"), "mark", "points")


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation on the start of its family's first one; a last row without mark ends each."""
    convs = own.groupBy("conv").agg(F.count("*").alias("size")).withColumns({
        "h": (decimal_crc("conv") % 6).cast("int"), "base": F.col("conv") - F.col("conv") % FAMILY})
    heads = own.where(f"pos < {MOST_HEAD}").groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "mark", "points"))).alias("head"))
    plan = durable(
        convs.join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
        .select("conv", "h", "k", "size", F.slice("head", 1, F.col("k")).alias("head")))
    start = plan.select("conv", F.inline("head"))
    later = own.where(F.col("pos") >= decimal_crc("conv") % 6).join(plan.select("conv", "h", "k"), "conv").select(
        "conv", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "mark", "points")
    ends = plan.select("conv", (F.col("k") + F.greatest(F.lit(0), F.col("size") - F.col("h"))).cast("long").alias("pos"),
                       F.lit("").alias("mark"), F.lit(0).cast("long").alias("points"))
    return start.unionByName(later).unionByName(ends)


def _blocks(sequences: DataFrame, block: int) -> DataFrame:
    turns_ = F.filter("turns", lambda t: t["mark"] != "")
    return (
        sequences.groupBy("conv", F.floor(F.col("pos") / block).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mark", "points"))).alias("turns"))
        .select("conv", "block", F.unhex(F.concat_ws("", F.col("turns.mark"))).alias("key"),
                F.transform(turns_, lambda t: t["points"]).alias("points")))


def _levels(sequences: DataFrame, block: int) -> list[DataFrame]:
    """Distinct blocks by level: the first one of all classes, a further one only of those that share all before with another."""
    current, levels = sequences.where("block = 0").withColumn("g", F.lit(0).cast("long")), []
    while True:
        entries = durable(current.groupBy("g", "key").agg(
            F.sum("m").alias("n"), F.min("conv").alias("low"), F.count("*").alias("classes"), F.first("points").alias("points"),
            F.first("before").alias("before"), F.max("size").alias("size"), F.max("total").alias("total")))
        levels.append(entries)
        shared = entries.where("classes > 1").select("g", "key", F.col("low").alias("next"))
        if shared.isEmpty():
            return levels
        onward = current.join(shared, ["g", "key"]).select("conv", F.col("next").alias("g"))
        current = durable(sequences.where(F.col("block") == len(levels)).join(onward, "conv"))


def elements(sequences: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """All elements of the trie, and its root."""
    levels, found, roots = _levels(sequences, block), None, None
    for level in range(len(levels) - 1, -1, -1):
        base, entries = level * block, levels[level]
        alone = F.col("classes") == 1
        if roots is None:
            entries = entries.withColumns({c: F.lit(None).cast("long") for c in ("r_kids", "r_leaves", "r_acc", "r_ender")})
        else:
            entries = entries.join(roots.select(
                F.col("g").alias("low"), F.col("kids").alias("r_kids"), F.col("leaves").alias("r_leaves"), F.col("acc").alias("r_acc"),
                F.col("ender").alias("r_ender")), "low", "left")
        inside = F.aggregate("points", F.lit(0).cast("long"), lambda a, x: a + x) + F.col("before")
        value = lambda one, many: F.when(alone, one).otherwise(many)
        shaped = entries.select(
            "g", "key", "low", "n", "points", "before", value(F.col("size"), F.lit(base + block)).cast("long").alias("hi"),
            value(F.lit(0), F.col("r_kids")).alias("kids"), value(F.lit(1), F.col("r_leaves")).alias("leaves"),
            value(F.lit(0), F.col("r_acc")).alias("below"), value(F.col("total"), inside).alias("deep"),
            value((F.col("n") - 1) * (F.col("total") - inside), F.col("r_acc")).alias("acc"),
            value(F.col("low"), F.col("r_ender")).alias("ender"))
        nodes, roots = _forest(shaped, base)
        found = nodes if found is None else found.unionByName(nodes)
    return found, roots


def trie(talks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    return nodes(rebuilt(durable(turns(talks))), block)


def nodes(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``sequences``: conv, pos, mark, points, with a last row without mark for each conv."""
    blocks = durable(_blocks(sequences, block))
    digest = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("block", F.sha2("key", 256).alias("s")))),
                                                 lambda b: b["s"])), 256)
    points = F.aggregate("points", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = durable(blocks.groupBy("conv").agg(
        digest.alias("digest"), F.sum(F.size("points")).alias("size"), F.sum(points).alias("total")))
    classes = durable(whole.groupBy("digest").agg(
        F.min("conv").alias("class"), F.count("*").alias("m"), F.first("size").alias("size"), F.first("total").alias("total")))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = durable(
        blocks.join(classes.select(F.col("class").alias("conv"), "m", "size", "total"), "conv")
        .withColumn("before", F.coalesce(F.sum(points).over(earlier), F.lit(0))))
    found, roots = elements(firsts, block)

    many = whole.join(classes.where("m > 1").select("digest", F.col("class").cast("string").alias("key")), "digest").select(
        "key", F.col("conv").cast("string").alias("member"), "conv")
    ends = (
        ordered.digests(many, "conv").select(F.col("key").cast("long").alias("ender"), F.col("sha").alias("ends"))
        .unionByName(classes.where("m = 1").select(
            F.col("class").alias("ender"), F.sha2(F.col("class").cast("string").cast("binary"), 256).alias("ends"))))

    spans = durable(found).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    first = F.greatest(F.col("lo") - F.col("block") * block, F.lit(0)) + 1
    last = F.least(F.col("hi") - F.col("block") * block, F.lit(block))
    stepped = (
        spans.join(firsts.select(F.col("conv").alias("low"), "block", "points", "before"), ["low", "block"])
        .withColumn("step", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .withColumns({
            "depth": F.col("block") * block + F.col("step"),
            "above": F.col("before") + F.aggregate(
                F.slice("points", 1, F.col("step") - 1), F.lit(0).cast("long"), lambda a, x: a + x)}))
    top, bottom = F.col("depth") == F.col("lo") + 1, F.col("depth") == F.col("hi")
    rows = stepped.select(
        F.col("low").alias("conv_id"), "depth", F.when(top, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("deep") - F.col("above"))).alias("saved_tokens"),
        F.when(bottom, F.col("ender")).alias("ender"))
    root = roots.select(
        F.col("low").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("acc").alias("saved_tokens"), "ender")
    return rows.unionByName(root).join(ends, "ender", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", ordered.empty_digest()).alias("ends_sha256"))
