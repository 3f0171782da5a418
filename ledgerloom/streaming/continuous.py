"""Continuous feeds: the batch replay guard, increment and edges on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import cost_cents, event_hash, fx_admissible
from ledgerloom.operators import replay
from ledgerloom.operators.matching import leg_pool, line_pool
from ledgerloom.runtime import durable, scratch


def stream_dedup(feed: DataFrame, columns: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """First copy of each fingerprint; state is kept for ``delay`` only."""
    return (
        feed.withColumn("event_hash", event_hash(*columns)).withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["event_hash"]))


class ReplayGuard:
    """Keeps one copy of each event of a feed and records every other, batch by batch.

    Tables under ``folder``: ``kept`` and ``replays`` (event_hash, row key and
    batch). A fingerprint covers the event's own day, so the copies of an event
    share a day: tables are partitioned by it, and a batch reads the
    fingerprints of its own days only, however long the history is.

    A batch writes into folders that carry its number and looks at lower
    numbers alone. Run again after a failure, it replaces its own rows and
    decides the same, so a restart neither loses nor repeats a row.
    """

    def __init__(self, folder: str, columns: Sequence[str], entity: str, row_key: str, day: str):
        self.folder, self.columns, self.entity, self.row_key, self.day = folder, columns, entity, row_key, day

    def table(self, spark, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def __call__(self, batch: DataFrame, number: int) -> None:
        with scratch():
            self._take(batch, number)

    def _take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = durable(replay.with_fingerprint(batch, self.columns).withColumn("event_day", F.coalesce(
            F.col(self.day).cast("date"), F.lit("1970-01-01").cast("date"))))
        seen = self.table(spark, "kept")
        fresh = rows
        if seen is not None:
            low, high = rows.agg(F.min("event_day"), F.max("event_day")).first()
            days = F.lit(False) if low is None else F.col("event_day").between(low, high)
            earlier = seen.filter(days & (F.col("batch") < number)).join(
                rows.select("event_day").distinct(), "event_day", "left_semi").select("event_hash")
            fresh = rows.join(earlier, "event_hash", "left_anti")
        # one row of each new event: the first by its key, found by a minimum before the shuffle
        first = durable(fresh.groupBy("event_hash").agg(F.min(self.row_key).alias(self.row_key)))
        kept = fresh.join(first, ["event_hash", self.row_key], "left_semi")
        again = rows.join(first, ["event_hash", self.row_key], "left_anti").select(
            "event_hash", self.row_key, "event_day", F.lit(self.entity).alias("entity_type"), F.lit(texts.REPLAY_REASON).alias("reason"))
        for name, part in (("replays", again), ("kept", kept)):
            (part.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("event_day", "batch").parquet(f"{self.folder}/{name}"))


def increments(feed: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of new rows to ``step``, e.g. an incremental run.

    The matching stages need closed candidate sets, so they run per batch.
    """
    return (
        feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def stream_edges(
    legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT, delay: str = "1 day", unmatched: bool = False,
) -> DataFrame:
    """Candidate edges of two streams within the fuzzy band.

    A leg lies in one amount and day block; a line is repeated into the at most
    two by two blocks its band touches, so each pair meets once and a leg that
    met no line is known as such in its one block. The blocks are part of the
    join's keys, so a merchant with a third of all rows is spread over its
    amounts and days in the state as well.

    Rows leave the state when the watermark of the other side has passed their
    band. With ``unmatched`` a leg that no line met until then comes out with
    null line and gaps. Rows that arrive later than ``delay`` may be dropped.
    """
    days, cents = cfg.fuzzy_days, cfg.fuzzy_cents
    scope = ["merchant_id", "payment_rail", "direction"]
    width, span = 2 * cents + 1, 2 * days + 1

    def day_number(name):
        return F.datediff(F.col(name), F.lit("1970-01-01").cast("date"))

    def touched(value, reach, size):
        return F.explode(F.sequence(F.floor((value - reach) / size), F.floor((value + reach) / size)))

    left = (
        leg_pool(legs).withColumn("leg_time", F.col("settlement_date").cast("timestamp")).withWatermark("leg_time", delay)
        .withColumns({"block": F.floor(F.col("recon_c") / width), "day_block": F.floor(day_number("settlement_date") / span)}))
    right = (
        line_pool(lines).withColumn("line_time", F.col("value_date").cast("timestamp")).withWatermark("line_time", delay)
        .withColumn("block", touched(F.col("amount_c"), cents, width))
        .withColumn("day_block", touched(day_number("value_date"), days, span)))
    left, right = left.alias("s"), right.alias("b")
    meets = F.expr(f"b.line_time BETWEEN s.leg_time - INTERVAL {days} DAYS AND s.leg_time + INTERVAL {days} DAYS")
    for name in (*scope, "block", "day_block"):
        meets = meets & (F.col(f"s.{name}") == F.col(f"b.{name}"))
    meets = meets & (F.abs(F.col("b.amount_c") - F.col("s.recon_c")) <= cents)
    meets = meets & fx_admissible("leg_currency", "line_currency", "has_expected")
    gap, day = F.abs(F.col("amount_c") - F.col("recon_c")), F.abs(F.datediff("value_date", "settlement_date"))
    return left.join(right, meets, "left_outer" if unmatched else "inner").select(
        "settlement_id", "bank_txn_id", gap.alias("amount_diff_c"), day.alias("day_diff"), cost_cents(gap, day, cfg).alias("cost_c"))
