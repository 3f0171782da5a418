"""Ranks within groups of any size.

A window over a group runs in one task. Here rows are dealt by range over the
group's key and the order within it, so that a group with a third of all rows
lies in a third of the tasks. A row's rank is its place among the rows of its
group in its own range, plus the sizes of the ranges before (a prefix sum over
at most one number per range and group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.runtime import durable


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank, from 1, among the rows with the same ``keys`` in ascending ``order`` (nulls first).

    ``order`` must leave no ties but between rows that are equal anyway. The
    rows are written once to the shared folder: which range a row lies in must
    not change between counting and ranking.
    """
    ranged = durable(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return _offset(ranged, keys).withColumn(name, F.coalesce("_before", F.lit(0)) + place).drop("_range", "_before")


def _offset(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each group in the ranges before, for the groups that go over more than one range.

    Such a group fills a range's end and the next one's beginning, so there
    are at most two for each range.
    """
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        sizes.withColumn("_parts", F.count(F.lit(1)).over(group)).filter("_parts > 1")
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"),
                F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_range") == F.col("_of_range")]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return ranged.join(split, condition, "left").drop("_of_range", *[f"_of_{k}" for k in keys])
