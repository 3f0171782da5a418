"""Band joins with blocks of several widths."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.bands import _day_number, _reach, band_join


def _sides(spark, n):
    rng = random.Random(5)
    rows = [[(f"{i}", "M", rng.randrange(-4000, 4000), f"2024-01-{rng.randrange(1, 31):02d}") for i in range(n)] for _ in "ab"]
    return [spark.createDataFrame(r, f"{s} string, m string, {s}_c bigint, day string").select(s, "m", f"{s}_c", F.col("day").cast("date").alias(f"{s}_d"))
            for r, s in zip(rows, "ab")]


@pytest.mark.parametrize("wide", [1, 2, 8])
def test_band_join_of_any_block_width(spark, wide):
    a, b = _sides(spark, 150)
    got = sorted((r.a, r.b, r.amount_diff_c, r.day_diff) for r in band_join(a, b, ["m"], "a_c", "a_d", "b_c", "b_d", 300, 3, wide=wide).collect())
    want = sorted((x.a, y.b, abs(x.a_c - y.b_c), abs((x.a_d - y.b_d).days)) for x in a.collect() for y in b.collect()
                  if abs(x.a_c - y.b_c) <= 300 and abs((x.a_d - y.b_d).days) <= 3)
    assert got == want and want


def test_band_join_repeats_few_rows(spark):
    """The repeated side holds at most 2.5 copies of a row, not four."""
    rows = spark.range(20_000).select(
        F.lit("M").alias("m"), (F.col("id") * 37 % 100_003).alias("a_c"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("a_d"))
    default = band_join.__defaults__[-1]
    copies = rows.select(F.size(_reach(F.col("a_c"), 1000, default)) * F.size(_reach(_day_number(F.col("a_d")), 7, default))).groupBy().avg().first()[0]
    assert copies < 2.5
