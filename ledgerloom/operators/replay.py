"""Replayed events and incremental runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerloom import texts
from ledgerloom.functions.scalars import event_hash

LEG_EVENT = ("merchant_id", "payment_rail", "settlement_id", "order_id", "type", "currency", "net_c", "recon_c", "settlement_date")
LINE_EVENT = ("merchant_id", "payment_rail", "bank_txn_id", "currency", "amount_c", "value_date", "narration")
# The narrower fingerprint of earlier runs, for reading their decisions.


_BLOCK = 4096


def with_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("event_hash", event_hash(*columns))


def dedup_events(
    feed: DataFrame, columns: Sequence[str], entity: str, row_key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit rows): one copy stays, each other copy is audited.

    Copies are counted down before the shuffle, so an event replayed a billion
    times is no hot key. With a unique ``row_key`` the first row by it stays
    and the audit names the others; without one the copies are only counted,
    and the audit has one numbered row for each.
    """
    hashed = with_fingerprint(feed, columns)
    note = [F.lit(entity).alias("entity_type"), F.lit(texts.REPLAY_REASON).alias("reason")]
    if row_key:
        first = hashed.groupBy("event_hash").agg(F.min(row_key).alias(row_key)).select(row_key)
        kept = hashed.join(first, row_key, "left_semi")
        replays = hashed.join(first, row_key, "left_anti").select("event_hash", row_key, *note)
        return kept, replays
    counted = hashed.groupBy("event_hash").agg(
        F.min(F.struct(*[F.col(c) for c in feed.columns])).alias("row"), F.count(F.lit(1)).alias("copies"))
    kept = counted.select("row.*", "event_hash")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 2) / _BLOCK)))
    number = F.explode(F.sequence(
        F.col("block") * _BLOCK + 2, F.least(F.col("copies"), (F.col("block") + 1) * _BLOCK + 1)))
    replays = (
        counted.filter("copies > 1").select("event_hash", "copies").withColumn("block", block)
        .withColumn("copy", number).select("event_hash", F.col("copy").cast("string").alias("copy"), *note))
    return kept, replays


def increment(legs: DataFrame, prior: DataFrame) -> DataFrame:
    """Legs whose fingerprint has no decision yet; changed content comes back in."""
    return legs.join(prior.select("event_hash"), "event_hash", "left_anti")
