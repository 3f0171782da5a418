"""Run metrics: each is one pass with partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import amount_bucket, day_bucket, pct, pretty_type


def run_counters(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def match_breakdown(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("match_type").agg(F.count(F.lit(1)).alias("matches")).withColumn(
        "display_name", pretty_type("match_type"))


def decision_tiers(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("match_type", "decision").agg(
        F.count(F.lit(1)).alias("links"), F.sum("amount_diff_c").alias("amount_diff_c"))


def run_summary(legs: DataFrame, decisions: DataFrame, exceptions: DataFrame, unexplained: DataFrame) -> DataFrame:
    """One row of totals; a lifecycle group counts once per leg."""
    counts = run_counters({
        "legs": legs, "auto": decisions.filter(F.col("decision") == texts.AUTO),
        "review": decisions.filter(F.col("decision") == texts.REVIEW),
        "exceptions": exceptions, "unexplained": unexplained})

    def of(name):
        return F.max(F.when(F.col("table_name") == name, F.col("row_count")))

    return counts.agg(
        of("legs").alias("total_settlements"), (of("auto") + of("review")).alias("matched_count"),
        pct(of("auto") + of("review"), of("legs")).alias("match_rate_pct"),
        of("auto").alias("auto_accepted_count"), of("review").alias("needs_review_count"),
        of("exceptions").alias("exception_count"), of("unexplained").alias("unexplained_count"))


def block_keys(df: DataFrame, cents: str, day: str, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return df.withColumns({
        "amount_bucket": amount_bucket(cents, cfg.fuzzy_cents), "date_bucket": day_bucket(day, cfg.fuzzy_days)})


def blocking_stats(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Pairs a blocked search compares, per direction, from block counts alone."""
    keys = ["merchant_id", "payment_rail", "direction"]
    blocks = ["amount_bucket", "date_bucket"]

    def counted(df, cents, day, name):
        sided = df.withColumn("direction", F.signum(cents).cast("int")).filter("direction <> 0")
        return block_keys(sided, cents, day, cfg).groupBy(*keys, *blocks).agg(F.count(F.lit(1)).alias(name))

    def span(bucket):
        # four buckets in a row meet as one; bucket and neighbours lie in at most two of these
        return bucket - F.pmod(bucket, F.lit(4))

    def around(name):
        return F.explode(F.array_distinct(F.array(span(F.col(name) - 1), span(F.col(name) + 1))))

    left = counted(legs, "recon_c", "settlement_date", "legs").withColumnsRenamed({b: f"_{b}" for b in blocks})
    right = counted(lines, "amount_c", "value_date", "lines").withColumns({f"_span{i}": span(F.col(b)) for i, b in enumerate(blocks)})
    probe = left.withColumn("_span0", around("_amount_bucket")).withColumn("_span1", around("_date_bucket"))
    apart = [F.abs(F.col(b) - F.col(f"_{b}")) <= 1 for b in blocks]
    return (
        probe.join(right, [*keys, "_span0", "_span1"]).filter(apart[0] & apart[1]).groupBy("direction")
        .agg(F.sum(F.col("legs") * F.col("lines")).cast("bigint").alias("blocked_pairs")))
