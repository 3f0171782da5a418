"""Gates for proposals that come from outside: they never change a decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import clip
from ledgerloom.operators.bands import _day_number, _reach

_REPLY = "recommended_bank_txn_id string, reason string, _bad string"


def score_candidates(queue: DataFrame, reply: Callable, batch_schema: str = "settlement_id string, raw string") -> DataFrame:
    """Raw replies of a user-supplied reviewer, batch by batch on the executors."""
    return queue.mapInPandas(reply, batch_schema)


def gate_recommendations(raw: DataFrame, queue: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Raw replies to queue items, failing closed.

    A malformed reply or an identifier outside the supplied candidates gives a
    null recommendation with the policy reason.
    """
    parsed = F.from_json("raw", _REPLY, {"columnNameOfCorruptRecord": "_bad"})
    is_object = F.coalesce(F.ltrim("raw").startswith("{"), F.lit(False))
    valid = is_object & F.col("p._bad").isNull()
    proposed = F.col("p.recommended_bank_txn_id")
    known = F.exists("top_candidates", lambda c: c["bank_txn_id"] == proposed)
    return (
        queue.select("settlement_id", "top_candidates").join(raw, "settlement_id")
        .withColumn("p", parsed)
        .select(
            "settlement_id",
            F.when(valid & known, proposed).alias("recommended_bank_txn_id"),
            F.when(~valid, texts.GATE_MALFORMED)
            .when(proposed.isNotNull() & ~known, texts.GATE_UNKNOWN_ID)
            .otherwise(clip(F.coalesce("p.reason", F.lit(texts.GATE_NO_REASON)))).alias("reason"),
            F.lit(cfg.policy_version).alias("policy_version"), F.lit(texts.ADVICE).alias("decision")))


def pack_sizes(unresolved: DataFrame, open_lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Open lines within the proposal window of each unresolved leg, counted by day."""
    scope = ["merchant_id", "payment_rail"]
    width = 2 * cfg.nearby_days + 1
    per_day = (
        open_lines.groupBy(*scope, "value_date").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_db", F.floor(_day_number(F.col("value_date")) / width)))
    leg_days = (
        unresolved.select(*scope, "settlement_date").distinct()
        .withColumn("_db", F.explode(_reach(_day_number(F.col("settlement_date")), cfg.nearby_days))))
    near = F.abs(F.datediff("value_date", "settlement_date")) <= cfg.nearby_days
    sizes = (
        leg_days.join(per_day, [*scope, "_db"]).filter(near)
        .groupBy(*scope, "settlement_date").agg(F.sum("n").alias("pack_size")))
    return unresolved.join(sizes, [*scope, "settlement_date"]).select("settlement_id", "pack_size")


def admit_candidates(
    proposals: DataFrame, unresolved: DataFrame, open_lines: DataFrame, cfg: MatchConfig = DEFAULT,
) -> DataFrame:
    """Proposals inside their leg's candidate pack, confident enough, on a free line.

    Membership is checked for the proposed pair alone; packs are never listed.
    A line goes to the first leg that asks for it.
    """
    leg = unresolved.select("settlement_id", "merchant_id", "payment_rail", "settlement_date")
    line = open_lines.select("bank_txn_id", "merchant_id", "payment_rail", "value_date")
    fit = (
        proposals.filter(F.col("confidence_pct") >= cfg.proposal_min_pct)
        .join(leg, "settlement_id").join(line, ["bank_txn_id", "merchant_id", "payment_rail"])
        .filter(F.abs(F.datediff("value_date", "settlement_date")) <= cfg.nearby_days))
    per_leg = fit.groupBy("settlement_id").agg(
        F.min(F.struct("bank_txn_id", "confidence_pct")).alias("p")).select("settlement_id", "p.*")
    return (
        per_leg.groupBy("bank_txn_id").agg(F.min(F.struct("settlement_id", "confidence_pct")).alias("p"))
        .select("p.settlement_id", "bank_txn_id",
                F.least(F.col("p.confidence_pct"), F.lit(cfg.proposal_cap_pct)).cast("bigint").alias("confidence_pct"),
                F.lit(texts.PROPOSED).alias("match_type")))
