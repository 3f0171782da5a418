"""Direction pools and what is still open after earlier links.

Links are the common output of the matching stages: settlement_id, bank_ids
(array), stage, confidence_pct, amount_diff_c, day_diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.scalars import direction
from ledgerloom.runtime import durable

_ID = "_repeated_id"
LINK_COLUMNS = ("settlement_id", "bank_ids", "stage", "confidence_pct", "amount_diff_c", "day_diff")


def with_direction(df: DataFrame, cents: str) -> DataFrame:
    """Credit (+1) or debit (-1) as a join key; a zero amount is in neither pool."""
    return df.withColumn("direction", direction(cents)).filter("direction <> 0")


def one_per_id(rows: DataFrame, id_col: str) -> DataFrame:
    """One row of each identifier, the smallest by its columns in order; rows without one stay."""
    # only identifiers are counted over all rows; whole rows are grouped where an identifier repeats
    repeated = durable(
        rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(_ID)).agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(_ID))
    same = F.col(id_col) == F.col(_ID)
    one = rows.join(repeated, same, "left_semi").groupBy(F.col(id_col).alias(_ID)).agg(
        F.min(F.struct(*rows.columns)).alias("_row")).select("_row.*")
    return rows.join(repeated, same, "left_anti").unionByName(one)


def repeated_ids(rows: DataFrame, source: str, id_col: str) -> DataFrame:
    """(source, row_id, copies): identifiers that several rows carry; one of the rows takes part in matching."""
    return (
        rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("row_id")).agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").select(F.lit(source).alias("source"), "row_id", "copies"))


def open_legs(legs: DataFrame, links: DataFrame) -> DataFrame:
    return legs.join(links.select("settlement_id"), "settlement_id", "left_anti")


def open_lines(lines: DataFrame, links: DataFrame) -> DataFrame:
    used = links.select(F.explode("bank_ids").alias("bank_txn_id"))
    return lines.join(used, "bank_txn_id", "left_anti")


def one_line_links(assigned: DataFrame, stage: str, confidence) -> DataFrame:
    return assigned.select(
        F.col("left_id").alias("settlement_id"), F.array("right_id").alias("bank_ids"),
        F.lit(stage).alias("stage"), confidence.cast("bigint").alias("confidence_pct"),
        F.col("info.amount_diff_c"), F.col("info.day_diff"))
