"""Blocked pairs from counts of blocks."""

import random

from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT
from ledgerloom.operators.summary import blocking_stats


def _frame(spark, rows, cents, day):
    return spark.createDataFrame(rows, f"merchant_id string, payment_rail string, {cents} bigint, n int").select(
        "merchant_id", "payment_rail", cents, F.expr("date_add(date'1969-12-01', n)").alias(day), F.col("n").alias(f"{day}_n"))


def test_blocked_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [[(rng.choice("MN"), "R", rng.choice([None, 0, *range(-9000, 9000, 250)]), rng.choice([None, *range(70)])) for _ in range(120)] for _ in "lr"]
    legs, lines = _frame(spark, rows[0], "recon_c", "settlement_date"), _frame(spark, rows[1], "amount_c", "value_date")
    got = {r.direction: r.blocked_pairs for r in blocking_stats(legs, lines).collect()}
    want = {}
    for m, _, a, d in rows[0]:
        for m2, _, b, e in rows[1]:
            if m == m2 and a and b and d is not None and e is not None and (a > 0) == (b > 0):
                days = [(x - 31) // DEFAULT.fuzzy_days for x in (d, e)]
                if abs(abs(a) // DEFAULT.fuzzy_cents - abs(b) // DEFAULT.fuzzy_cents) <= 1 and abs(days[0] - days[1]) <= 1:
                    want[1 if a > 0 else -1] = want.get(1 if a > 0 else -1, 0) + 1
    assert got == want and len(want) == 2


def test_a_block_is_not_repeated_nine_times(spark):
    """Rows that reach the join: at most two copies each way, and most blocks have fewer."""
    legs = spark.range(400).select(
        F.lit("M").alias("merchant_id"), F.lit("R").alias("payment_rail"), ((F.col("id") % 20 + 1) * DEFAULT.fuzzy_cents).alias("recon_c"),
        F.expr(f"date_add(date'2024-01-01', cast(id div 20 * {DEFAULT.fuzzy_days} as int))").alias("settlement_date"))
    lines = legs.withColumnsRenamed({"recon_c": "amount_c", "settlement_date": "value_date"})
    text = blocking_stats(legs, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate explode") == 2 and "[-1,0,1]" not in text
    # 20 by 20 neighbouring blocks: three neighbours each way but at the rims
    assert [tuple(r) for r in blocking_stats(legs, lines).collect()] == [(1, 58 * 58)]
