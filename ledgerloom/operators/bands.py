"""Band join: pairs whose amounts and days differ by at most a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scalars import amount_gap, day_gap

_EPOCH = "1970-01-01"


def _day_number(col: Column) -> Column:
    return F.datediff(col, F.lit(_EPOCH).cast("date"))


def _reach(value: Column, tolerance: int, wide: int = 1) -> Column:
    """Blocks of ``wide`` times 2*tolerance+1 that a value's band can touch: at most two."""
    width = wide * (2 * tolerance + 1)
    low = F.floor((value - tolerance) / width)
    high = F.floor((value + tolerance) / width)
    return F.sequence(low, high)


def band_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_amount: str,
    left_day: str,
    right_amount: str,
    right_day: str,
    cents: int,
    days: int,
    wide: int = 2,
) -> DataFrame:
    """Inner band join as an equi-join.

    The left side is repeated into the (at most two by two) amount and day
    blocks its band touches, the right side sits in exactly one block, so each
    qualifying pair meets once and the block is part of the shuffle key. A hot
    ``on`` key is thereby spread over its amounts and days. A block is ``wide``
    bands across: of width w a band touches 1 + 1/w blocks each way, so wider
    blocks repeat fewer rows in the shuffle and compare more pairs in the join.
    Column names of the two sides must differ apart from ``on``. Adds
    amount_diff_c, day_diff.
    """
    probe = (
        left.withColumn("_ab", F.explode(_reach(F.col(left_amount), cents, wide)))
        .withColumn("_db", F.explode(_reach(_day_number(F.col(left_day)), days, wide)))
    )
    build = right.withColumns({
        "_ab": F.floor(F.col(right_amount) / (wide * (2 * cents + 1))),
        "_db": F.floor(_day_number(F.col(right_day)) / (wide * (2 * days + 1))),
    })
    return (
        probe.join(build, [*on, "_ab", "_db"])
        .withColumns({
            "amount_diff_c": amount_gap(left_amount, right_amount),
            "day_diff": day_gap(left_day, right_day),
        })
        .filter((F.col("amount_diff_c") <= cents) & (F.col("day_diff") <= days))
        .drop("_ab", "_db")
    )
