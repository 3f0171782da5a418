"""Greedy assignment again after some cells changed, on the part they can reach.

The walk of ``greedy`` goes through the candidates by (cost, turn), and what a
candidate gets depends only on the candidates before it at its own ends. So a
change reaches a candidate if the candidate stands at a changed cell, or comes
after a reached one at a common end. For each end the first reached place is
kept; a candidate is reached if and only if it stands at or behind the place
of its ends. Links before these places stand with the very rows they have,
the rest is matched anew with the rows that those leave. The result equals a
walk through all candidates.

The places are found in rounds: each passes the places that moved in the last
one on to the other ends, so only the candidates between a place's old and new
position are read on. There is no cap; a round is one map-side combined
minimum per end and one write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.greedy import links_of_cells, tie_key
from ledgerloom.runtime import counted, durable, release

_FIRST = -(2**63)


def changed_cells(before: DataFrame, after: DataFrame, cell: str, size: str, side: str) -> DataFrame:
    """Ends ("L" or "R" and the cell) of one side that came, went or changed in size."""
    old = before.select(F.col(cell).alias("cell"), F.col(size).alias("old"))
    new = after.select(F.col(cell).alias("cell"), F.col(size).alias("new"))
    moved = old.join(new, "cell", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return moved.select(F.concat(F.lit(side), "cell").alias("node"))


def _ends(second: str):
    left, right = F.concat(F.lit("L"), "left"), F.concat(F.lit("R"), "right")
    return F.array_distinct(F.array(left, right, F.coalesce(F.concat(F.lit("R"), F.col(second)), right)))


def _with_place(candidates: DataFrame) -> DataFrame:
    """Candidates with right2, their place in the walk and their ends."""
    if "right2" not in candidates.columns:
        candidates = candidates.withColumns({
            "right2": F.lit(None).cast("string"), "right2_n": F.lit(None).cast("bigint")})
    turn = F.md5(tie_key("left", "right", "right2").cast("binary"))
    return candidates.withColumns({
        "place": F.struct(F.col("cost").cast("bigint").alias("cost"), turn.alias("turn")), "ends": _ends("right2")})


def reached_places(candidates: DataFrame, before: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, place): the first place at each end that a change reaches.

    ``candidates`` as made by ``_with_place``; ends without a row are not reached.
    """
    by_end = durable(candidates.select(F.explode("ends").alias("node"), "place", "ends"))
    start = F.struct(F.lit(_FIRST).alias("cost"), F.lit("").alias("turn"))
    changed = changed.select("node").distinct()
    # a link of a cell that changed leaves its other ends from its place on
    lost = _with_place(before).select(F.explode("ends").alias("node"), "place", "ends").join(changed, "node", "left_semi")
    places = durable(
        changed.select("node", start.alias("place"))
        .unionByName(lost.select(F.explode("ends").alias("node"), "place"))
        .groupBy("node").agg(F.min("place").alias("place"))
        .withColumns({"until": F.lit(None).cast("struct<cost:bigint,turn:string>"), "moved": F.lit(True)}))
    moving = 1
    while moving:
        front = places.filter("moved").select("node", F.col("place").alias("since"), "until")
        passed = (
            by_end.join(front, "node")
            .filter((F.col("place") >= F.col("since")) & (F.col("until").isNull() | (F.col("place") < F.col("until"))))
            .select(F.explode("ends").alias("node"), "place")
            .groupBy("node").agg(F.min("place").alias("reached")))
        sooner = F.col("place").isNull() | (F.col("reached") < F.col("place"))
        after, moving = counted(
            places.select("node", "place").join(passed, "node", "full").select(
                "node", F.when(sooner & F.col("reached").isNotNull(), F.col("reached")).otherwise(F.col("place")).alias("place"),
                F.col("place").alias("until"), F.coalesce(sooner, F.lit(False)).alias("moved")),
            "moved")
        release(places)
        places = after
    release(by_end)
    return places.select("node", "place")


def rematch(candidates: DataFrame, before: DataFrame, changed: DataFrame, pairs: bool = False) -> DataFrame:
    """Links of cells over ``candidates``, like ``links_of_cells``.

    ``before`` are the links of cells chosen over the earlier candidates, and
    ``changed`` the ends (``node``) whose cells came, went or changed in size
    since; all other cells must have kept their candidates among each other.
    """
    placed = durable(_with_place(candidates))
    places = reached_places(placed, before, changed)
    at_left = places.select(F.col("node").alias("_node"), F.col("place").alias("_from"))

    def against(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("_node", F.concat(F.lit("L"), "left")).join(at_left, "_node", "left")
        # a reached candidate is reached at all of its ends, so one of them tells
        return frame.withColumn("_again", F.coalesce(F.col("place") >= F.col("_from"), F.lit(False))).drop("_node", "_from")

    stands = durable(against(_with_place(before)).filter("NOT _again").drop("place", "ends", "_again"))
    twin = F.coalesce(F.col("right") == F.col("right2"), F.lit(False))
    rows = F.array(
        F.struct(F.concat(F.lit("L"), "left").alias("node"), F.col("links").alias("n")),
        F.struct(F.concat(F.lit("R"), "right").alias("node"), F.when(twin, F.col("links") * 2).otherwise(F.col("links")).alias("n")),
        F.struct(F.when(~twin, F.concat(F.lit("R"), F.col("right2"))).alias("node"), F.col("links").alias("n")))
    used = durable(
        stands.select(F.explode(rows).alias("u")).select("u.node", "u.n").filter("node IS NOT NULL")
        .join(places, "node", "left_semi").groupBy("node").agg(F.sum("n").alias("n")))
    again = against(placed).filter("_again").drop("place", "ends", "_again")
    for side, name in (("L", "left"), ("R", "right"), ("R", "right2")) if pairs else (("L", "left"), ("R", "right")):
        taken = used.select(F.col("node").alias("_node"), F.col("n").alias(f"{name}_used"))
        again = (
            again.withColumn("_node", F.concat(F.lit(side), F.col(name))).join(taken, "_node", "left").drop("_node")
            .withColumn(f"{name}_used", F.coalesce(f"{name}_used", F.lit(0).cast("bigint"))))
    room = F.col("right_n") - F.col("right_used") >= F.when(twin, 2).otherwise(1)
    if pairs:
        room &= F.col("right2").isNull() | (F.col("right2_n") > F.col("right2_used"))
    again = again.filter((F.col("left_n") > F.col("left_used")) & room)
    return stands.unionByName(links_of_cells(again, pairs))
