"""Cells: rows that matching cannot tell apart, held once with a count.

Two legs with the same keys, amount and day have the same candidates at the
same cost; only their identifiers differ, and those decide nothing but order.
Candidate search therefore runs between distinct cells, and a group of a
billion copies is one row with a count. Within a cell identifiers are used up
in ascending order, so an identifier is found again by its rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.runtime import durable


def cells(rows: DataFrame, keys: Sequence[str], id_col: str, cell: str, size: str) -> DataFrame:
    """One row per distinct key tuple, named by its smallest identifier."""
    return rows.groupBy(*keys).agg(F.min(id_col).alias(cell), F.count(F.lit(1)).alias(size))


def members(
    rows: DataFrame, keys: Sequence[str], id_col: str, cell: str, size: str, used: DataFrame,
) -> DataFrame:
    """(cell, rank, id) for every cell of more than one row named in ``used``.

    A cell is found by the row it is named after, so the rows of other cells
    are not grouped again, and few cells are joined without a shuffle of all
    rows. Ranks come from a range partitioning on (cell, id), whatever the sizes of
    the cells: the row number in a range plus the sizes of the ranges before.
    """
    named = rows.join(used, F.col(id_col) == F.col("cell"), "left_semi").select(*keys).distinct()
    near = durable(rows.join(named, list(keys), "left_semi").select(*dict.fromkeys([*keys, id_col])))
    shared = (
        cells(near, keys, id_col, cell, size).filter(F.col(size) > 1).withColumnRenamed(cell, "cell")
        .join(used, "cell", "left_semi").select(*keys, "cell"))
    # written first: a range partitioning reads its input twice
    return ranged_rank(durable(near.join(shared, list(keys)).select("cell", F.col(id_col).alias("id"))))


def ranged_rank(named: DataFrame) -> DataFrame:
    ranged = durable(named.repartitionByRange("cell", "id").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("cell", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    local = F.row_number().over(Window.partitionBy("part", "cell").orderBy("id"))
    return (
        ranged.withColumn("local", local)
        .join(offsets, ["cell", "part"])
        .select("cell", "id", (F.col("offset") + F.col("local")).alias("rank"))
    )
