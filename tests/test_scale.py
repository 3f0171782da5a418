"""Hot keys: ranks over ranges, and splits without stored triples."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT
from ledgerloom.operators import evidence, greedy, matching, twosum
from ledgerloom.operators.cells import cells
from ledgerloom.operators.ranks import ranked
from tests.test_matching import frames


def hot_edges(spark, n):
    """One leg with two thirds of all edges, the rest on few lines."""
    k = F.col("id")
    return spark.range(n).select(
        F.when(k % 3 > 0, "HOT").otherwise(F.concat(F.lit("S"), k % 11)).alias("settlement_id"), F.format_string("B%07d", k % (n // 2)).alias("bank_txn_id"),
        (F.xxhash64(k) % 5 == 0).alias("has_id"), F.abs(F.xxhash64(k, F.lit(1)) % 40).alias("cost_c"))


def test_candidate_ranks_equal_windows(spark):
    edges = hot_edges(spark, 6000).dropDuplicates(["settlement_id", "bank_txn_id"])
    got = {(r.settlement_id, r.bank_txn_id): (r.settlement_rank, r.bank_rank) for r in evidence.candidate_ranks(edges).collect()}
    rows, want = edges.collect(), {}
    for side, of, other in ((0, "settlement_id", "bank_txn_id"), (1, "bank_txn_id", "settlement_id")):
        groups = {}
        for r in rows:
            groups.setdefault(r[of], []).append((not r.has_id, r.cost_c, r[other], (r.settlement_id, r.bank_txn_id)))
        for members in groups.values():
            for rank, m in enumerate(sorted(members), 1):
                want.setdefault(m[3], [0, 0])[side] = rank
    assert got == {k: tuple(v) for k, v in want.items()}


def test_a_hot_key_takes_all_tasks(spark):
    """Edges of which two thirds share one key: no task ranks more than a small part of them."""
    edges = hot_edges(spark, 300_000).withColumn("no_id", ~F.col("has_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = ranked(edges, ["settlement_id"], ["no_id", "cost_c", "bank_txn_id"])
        rows = done.filter("settlement_id = 'HOT'").groupBy("rank").count().agg(F.count("*"), F.max("rank"), F.max("count")).first()
        hot = edges.filter("settlement_id = 'HOT'").count()
        assert tuple(rows) == (hot, hot, 1)
        tasks = [r["count"] for r in done.filter("settlement_id = 'HOT'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) >= 4 and max(tasks) < hot * 0.6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_and_ties_in_ranks(spark):
    rows = [(None, 2), (None, None), ("a", 1), ("a", 1), ("a", None)]
    got = sorted(map(tuple, ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"]).collect()), key=repr)
    assert got == sorted([(None, None, 1), (None, 2, 2), ("a", None, 1), ("a", 1, 2), ("a", 1, 3)], key=repr)
    assert ranked(spark.createDataFrame([], "k string, v int"), ["k"], ["v"]).count() == 0


def _split_cells(pair):
    legs, lines = matching.leg_pool(pair[0]), matching.line_pool(pair[1])
    return (cells(legs, matching._LEG_KEYS, "settlement_id", "left", "left_n"), cells(lines, matching._LINE_KEYS, "bank_txn_id", "right", "right_n"))


def _week(seed, legs, lines, top):
    draw = random.Random(seed)
    amounts = draw.sample(range(10_000, top), lines)
    left = [(f"S{i:04d}", f"ORD{i}", sum(draw.sample(amounts, 2)) + draw.randint(-300, 300), draw.randint(1, 3), "settlement") for i in range(legs)]
    return left, [(f"B{i:04d}", a, draw.randint(1, 4), "CR") for i, a in enumerate(amounts)]


@pytest.mark.parametrize("seed", [1])
def test_index_takes_the_triples_that_a_list_of_all_would(spark, seed):
    pair = frames(spark, *_week(seed, 60, 70, 14_000))
    leg_cells, line_cells = _split_cells(pair)
    edges = matching.split_edges(leg_cells, line_cells)
    listed = greedy.links_of_cells(edges.select(
        F.lit(0).cast("bigint").alias("cost"), "left", "left_n", F.col("right1").alias("right"), F.col("right_n1").alias("right_n"),
        "right2", F.col("right_n2").alias("right2_n"), F.struct("amount_diff_c", "day_diff").alias("info")), pairs=True)
    name = lambda df: sorted((r.left, *sorted([r.right, r.right2]), r.links, *r.info) for r in df.collect())
    got = name(twosum.choose(edges, leg_cells, line_cells, DEFAULT))
    assert got == name(listed) and got


def test_a_merchant_week_of_many_amounts(spark):
    """Many more triples than rows of the index."""
    pair = frames(spark, *_week(5, 160, 160, 12_000))
    leg_cells, line_cells = _split_cells(pair)
    edges = matching.split_edges(leg_cells, line_cells)
    triples, rows = edges.count(), twosum.index(edges).count()
    assert rows <= leg_cells.count() * line_cells.count() and triples > 5 * rows
    won = matching.split_match(*pair).collect()
    used = [b for r in won for b in r.bank_ids]
    assert len(used) == len(set(used)) and len(won) > 40
