"""Matching again after changes equals matching everything."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.greedy import links_of_cells
from ledgerloom.operators.rematch import _with_place, changed_cells, reached_places, rematch
from ledgerloom.runtime import durable, scratch

CANDIDATE = "cost long, left string, left_n long, right string, right_n long, info struct<none:int>"
PAIR = CANDIDATE.replace("info", "right2 string, right2_n long, info")


def cost_of(*cells):
    """The same candidate has the same cost before and after; many costs tie."""
    return random.Random("|".join(map(str, cells))).randint(0, 6)


def candidates(spark, left, right, pairs, reach=3):
    rows = []
    for l, m in left.items():
        for r, n in right.items():
            if abs(l - r) > reach:
                continue
            if not pairs:
                rows.append((cost_of(l, r), f"l{l}", m, f"r{r}", n, (0,)))
                continue
            for r2, n2 in right.items():
                if r <= r2 <= r + 1 and (r != r2 or n > 1):
                    rows.append((cost_of(l, r, r2), f"l{l}", m, f"r{r}", n, f"r{r2}", n2, (0,)))
    return spark.createDataFrame(rows, PAIR if pairs else CANDIDATE)


def sizes(spark, left, right):
    named = lambda cells, mark: spark.createDataFrame([(f"{mark}{c}", n) for c, n in cells.items()], "cell string, n long")
    return named(left, "l"), named(right, "r")


def changes(spark, old, new):
    (l0, r0), (l1, r1) = sizes(spark, *old), sizes(spark, *new)
    return changed_cells(l0, l1, "cell", "n", "L").unionByName(changed_cells(r0, r1, "cell", "n", "R"))


def plain(links):
    return sorted(
        (r.cost, r.left, r.left_n, r.left_used, r.right, r.right_n, r.right_used, str(r.right2), r.right2_used, r.links)
        for r in links.collect())


def altered(draw, cells, count, wide):
    """Some cells gone, some new, some of another size."""
    out = dict(cells)
    for _ in range(count):
        cell = draw.randrange(wide)
        if draw.random() < 0.3:
            out.pop(cell, None)
        else:
            out[cell] = draw.randint(1, 4)
    return out


@pytest.mark.parametrize("pairs, seed", [(False, 1), (False, 2), (True, 4)])
def test_random_increments_equal_a_full_run(spark, pairs, seed):
    draw, wide = random.Random(seed), 30
    now = [{c: draw.randint(1, 4) for c in range(wide) if draw.random() < 0.7} for _ in range(2)]
    links = durable(links_of_cells(candidates(spark, *now, pairs), pairs))
    for _ in range(2):
        new = [altered(draw, side, 3, wide) for side in now]
        with scratch():
            links = durable(rematch(candidates(spark, *new, pairs), links, changes(spark, now, new), pairs), keep=True)
            assert plain(links) == plain(links_of_cells(candidates(spark, *new, pairs), pairs))
        now = new


def test_nothing_changed_and_nothing_before(spark):
    side = {c: 2 for c in range(12)}
    all_of = candidates(spark, side, side, False)
    links = durable(links_of_cells(all_of))
    nothing = changes(spark, (side, side), (side, side))
    assert plain(rematch(all_of, links, nothing)) == plain(links)
    everything = changes(spark, ({}, {}), (side, side))
    assert plain(rematch(all_of, links.limit(0), everything)) == plain(links)


def test_a_small_change_reaches_little(spark):
    """2,000 cells a side in one connected band: two new rows touch only the candidates near them."""
    wide = 2000
    old = spark.range(wide).select(F.col("id").alias("c"))
    edges = (
        old.select(F.col("c").alias("l")).withColumn("r", F.explode(F.sequence(F.col("l") - 2, F.col("l") + 2)))
        .filter(f"r between 0 and {wide - 1}")
        .select(F.pmod(F.xxhash64("l", "r"), F.lit(50)).alias("cost"), F.concat(F.lit("l"), "l").alias("left"),
                F.lit(1).cast("long").alias("left_n"), F.concat(F.lit("r"), "r").alias("right"),
                F.lit(1).cast("long").alias("right_n"), F.struct(F.lit(0).alias("none")).alias("info")))
    edges = durable(edges)
    fresh = F.col("left").isin("l700", "l1500")
    before = durable(links_of_cells(edges.filter(~fresh)))
    changed = spark.createDataFrame([("Ll700",), ("Ll1500",)], "node string")
    assert plain(rematch(edges, before, changed)) == plain(links_of_cells(edges))
    assert reached_places(durable(_with_place(edges)), before, changed).count() < 200
