"""Greedy choice of leg = line + line without a table of triples.

The walk takes triples (leg cell, two line cells) in the order of a hash, each
as often as all three have rows left; rounds take every triple that is first
at all of its ends (see ``greedy``). A leg and a line may form triples with
very many second lines, but a round asks only for the first of them. So the
stored state is a two-sum index: one row for each leg and line that fit
together, with the second line that comes first, its witness. The smallest
witness of a leg's rows is the leg's first triple, that of a line's rows the
line's. When a line is used up, its own rows go, and the rows that named it as
their witness look up the complement again among the lines that are left;
triples exist only between that band join and its map-side minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.functions.scalars import fx_admissible
from ledgerloom.operators.bands import band_join
from ledgerloom.operators.greedy import turn
from ledgerloom.runtime import counted, durable

SCOPE = ["merchant_id", "payment_rail", "direction"]


def index(triples: DataFrame) -> DataFrame:
    """For each leg and line the first of their triples: (left, own, other, turn, sizes and gaps).

    ``triples`` (left, left_n, right1, right_n1, right2, right_n2, gaps) is
    only read once, by an aggregation that starts before the shuffle.
    """
    def side(own, other):
        return F.struct(F.col(f"right{own}").alias("own"), F.col(f"right_n{own}").alias("own_n"), F.col(f"right{other}").alias("other"))

    both = F.when(F.col("right1") == F.col("right2"), F.array(side(1, 2))).otherwise(F.array(side(1, 2), side(2, 1)))
    zero = F.lit(0).cast("bigint")
    return (
        triples.select("left", "left_n", turn("left", "right1", "right2").alias("turn"), "amount_diff_c", "day_diff",
                       F.explode(both).alias("s"))
        .groupBy("left", "left_n", F.col("s.own").alias("own"), F.col("s.own_n").alias("own_n"))
        .agg(F.min(F.struct("turn", F.col("s.other").alias("other"), "amount_diff_c", "day_diff")).alias("w"))
        .select("left", "left_n", zero.alias("left_used"), "own", "own_n", zero.alias("own_used"), "w.*"))


# Rows of the index -> first triple of each end -> triples that are first at
# all their ends, with the rows they take.
_WON = """
WITH ends AS (
  SELECT inline(array(
    struct(concat('L', `left`) AS node, struct(turn, `left`, least(own, other) AS x, greatest(own, other) AS y,
           left_n, left_used, own, own_n, own_used, amount_diff_c, day_diff) AS key),
    struct(concat('R', own) AS node, struct(turn, `left`, least(own, other) AS x, greatest(own, other) AS y,
           left_n, left_used, own, own_n, own_used, amount_diff_c, day_diff) AS key)))
  FROM {rows}),
firsts AS (SELECT node, min(key) AS key FROM ends GROUP BY node),
won AS (
  SELECT key.turn, key.`left`, key.x, key.y, key.left_n, key.left_used, key.amount_diff_c, key.day_diff,
    max(CASE WHEN key.own = key.x THEN key.own_n END) AS x_n, max(CASE WHEN key.own = key.x THEN key.own_used END) AS x_used,
    max(CASE WHEN key.own = key.y THEN key.own_n END) AS y_n, max(CASE WHEN key.own = key.y THEN key.own_used END) AS y_used
  FROM firsts
  GROUP BY key.turn, key.`left`, key.x, key.y, key.left_n, key.left_used, key.amount_diff_c, key.day_diff
  HAVING count(*) = CASE WHEN key.x = key.y THEN 2 ELSE 3 END)
SELECT *, least(left_n - left_used, CASE WHEN x = y THEN (x_n - x_used) div 2
                                         ELSE least(x_n - x_used, y_n - y_used) END) AS links FROM won"""

_MOVED = """
WITH used AS (
  SELECT u.node, u.n FROM {won} LATERAL VIEW inline(array(
    struct(concat('L', `left`) AS node, links AS n),
    struct(concat('R', x) AS node, CASE WHEN x = y THEN links * 2 ELSE links END AS n),
    struct(CASE WHEN x <> y THEN concat('R', y) END AS node, links AS n))) u
  WHERE u.node IS NOT NULL)
SELECT `left`, left_n, left_used + coalesce(a.n, 0) AS left_used, own, own_n, own_used + coalesce(b.n, 0) AS own_used,
       other, turn, amount_diff_c, day_diff,
       g.line IS NOT NULL OR (own = other AND own_n - own_used - coalesce(b.n, 0) < 2) AS orphan
FROM {rows}
LEFT JOIN used a ON a.node = concat('L', `left`)
LEFT JOIN used b ON b.node = concat('R', own)
LEFT JOIN {fresh} g ON g.line = other
WHERE left_n > left_used + coalesce(a.n, 0) AND own_n > own_used + coalesce(b.n, 0)"""

_STATE = ["left", "left_n", "left_used", "own", "own_n", "own_used", "other", "turn", "amount_diff_c", "day_diff"]


def choose(triples: DataFrame, leg_cells: DataFrame, line_cells: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Chosen triples with their ``links`` and the rows used before them, as ``greedy.expand`` takes them."""
    rows, left_open = counted(index(triples))
    spark, taken, gone = rows.sparkSession, None, None
    while left_open:
        won = durable(spark.sql(_WON, rows=rows))
        taken = won if taken is None else taken.unionByName(won)
        ends = won.select(F.inline(F.array(
            F.struct(F.col("x").alias("line"), (F.col("x_n") - F.col("x_used")).alias("left_over"), F.expr("IF(x = y, 2, 1) * links").alias("used")),
            F.struct(F.col("y").alias("line"), (F.col("y_n") - F.col("y_used")).alias("left_over"), F.expr("IF(x = y, 2, 1) * links").alias("used")))))
        fresh = durable(ends.filter("left_over <= used").select("line").distinct())
        gone = fresh if gone is None else durable(gone.unionByName(fresh))
        moved, orphans = counted(spark.sql(_MOVED, rows=rows, won=won, fresh=fresh), "orphan")
        rows = moved.filter("NOT orphan").select(*_STATE)
        if orphans:
            open_lines = line_cells.join(gone.withColumnRenamed("line", "right"), "right", "left_anti")
            rows = rows.unionByName(_again(moved.filter("orphan"), leg_cells, open_lines, cfg))
        rows, left_open = counted(rows)
    if taken is None:
        taken = spark.sql(_WON, rows=rows)
    return taken.select(
        F.lit(0).cast("bigint").alias("cost"), "left", "left_n", "left_used", F.col("x").alias("right"), F.col("x_n").alias("right_n"),
        F.col("x_used").alias("right_used"), F.col("y").alias("right2"), F.col("y_n").alias("right2_n"), F.col("y_used").alias("right2_used"),
        F.struct("amount_diff_c", "day_diff").alias("info"), "links")


def _again(orphans: DataFrame, leg_cells: DataFrame, open_lines: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The index rows of ``orphans`` with their next witness; rows that have none are gone."""
    own = open_lines.select(F.col("right").alias("own"), F.col("amount_c").alias("own_c"), F.col("value_date").alias("own_date"))
    asked = (
        orphans.select("left", "left_n", "left_used", "own", "own_n", "own_used").join(leg_cells.drop("left_n"), "left").join(own, "own")
        .withColumn("rest_c", F.col("recon_c") - F.col("own_c")))
    spare = F.when(F.col("own") == F.col("right"), F.col("own_n") - F.col("own_used") > 1).otherwise(True)
    fits = band_join(asked, open_lines, SCOPE, "rest_c", "settlement_date", "amount_c", "value_date", cfg.split_cents, cfg.split_days)
    return (
        fits.filter(spare & fx_admissible("leg_currency", "line_currency", "has_expected"))
        .withColumns({
            "turn": turn("left", "own", "right"),
            "day_diff": F.greatest("day_diff", F.abs(F.datediff("own_date", "settlement_date")))})
        .groupBy("left", "left_n", "left_used", "own", "own_n", "own_used")
        .agg(F.min(F.struct("turn", F.col("right").alias("other"), "amount_diff_c", "day_diff")).alias("w"))
        .select("left", "left_n", "left_used", "own", "own_n", "own_used", "w.*").select(*_STATE))
