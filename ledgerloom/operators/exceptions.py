"""Exception register, unexplained lines and ledger duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.operators.bands import _day_number, _reach
from ledgerloom.operators.cells import cells
from ledgerloom.operators.matching import amount_date_edges

_SCOPE = ["merchant_id", "payment_rail", "direction"]
_LEG_KEYS = [*_SCOPE, "leg_currency", "has_expected", "recon_c", "settlement_date"]
_LINE_KEYS = [*_SCOPE, "line_currency", "amount_c", "value_date"]


def _side(cents: str):
    return F.when(F.col(cents) > 0, 1).otherwise(-1)


def plausible_counts(unresolved: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Number of lines of the whole bank inside each leg's fuzzy band.

    Counted between cells: copies add up without being paired.
    """
    legs = (
        unresolved.withColumn("direction", _side("recon_c"))
        .withColumnRenamed("currency", "leg_currency"))
    bank = lines.withColumn("direction", _side("amount_c")).withColumnRenamed("currency", "line_currency")
    leg_cells = cells(legs, _LEG_KEYS, "settlement_id", "left", "left_n")
    line_cells = cells(bank, _LINE_KEYS, "bank_txn_id", "right", "right_n")
    counts = (
        amount_date_edges(leg_cells, line_cells, cfg)
        .groupBy(*_LEG_KEYS).agg(F.sum("right_n").alias("plausible")))
    return (
        legs.join(counts, _LEG_KEYS, "left")
        .withColumn("plausible", F.coalesce("plausible", F.lit(0)).cast("bigint"))
        .withColumnRenamed("leg_currency", "currency").drop("direction"))


def nearby_days(unresolved: DataFrame, lines: DataFrame, days: int) -> DataFrame:
    """Distinct (merchant, rail, leg day) with any bank line in the window."""
    scope = ["merchant_id", "payment_rail"]
    leg_days = (
        unresolved.select(*scope, "settlement_date").distinct()
        .withColumn("_db", F.explode(_reach(_day_number(F.col("settlement_date")), days))))
    line_days = (
        lines.select(*scope, "value_date").distinct()
        .withColumn("_db", F.floor(_day_number(F.col("value_date")) / (2 * days + 1))))
    near = F.abs(F.datediff("value_date", "settlement_date")) <= days
    return leg_days.join(line_days, [*scope, "_db"]).filter(near).select(*scope, "settlement_date").distinct()


def classify_exceptions(unresolved: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Unresolved legs with the detailed reason."""
    reason = None
    for kind, text in texts.REASON_BY_TYPE.items():
        hit = F.col("type") == kind
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    reason = (
        reason.when(F.col("plausible") > 1, texts.REASON_AMBIGUOUS)
        .when(F.col("nearby").isNull(), F.when(F.col("net_c") < 0, texts.REASON_NO_DEBIT).otherwise(texts.REASON_NO_CREDIT))
        .otherwise(texts.REASON_OUTSIDE))
    near = nearby_days(unresolved, lines, cfg.nearby_days).withColumn("nearby", F.lit(True))
    return (
        plausible_counts(unresolved, lines, cfg)
        .join(near, ["merchant_id", "payment_rail", "settlement_date"], "left")
        .select(F.lit("settlement").alias("entity_type"), "settlement_id", "order_id", "net_c", "settlement_date",
                reason.alias("reason")))


def repeated_orders(ledger: DataFrame) -> DataFrame:
    """Orders entered more than once."""
    return (
        ledger.groupBy("merchant_id", "order_id").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")
        .withColumn("reason", F.format_string(texts.LEDGER_REPEAT_FORMAT, "records")))


def ledger_duplicates(ledger: DataFrame, legs: DataFrame) -> DataFrame:
    """Repeated orders that have a processor payment leg, as exceptions."""
    paid = (
        legs.filter(F.col("type").isin(*texts.BASE_TYPES))
        .groupBy("merchant_id", "order_id").agg(F.count(F.lit(1)).alias("payments")))
    twice = (
        ledger.groupBy("merchant_id", "order_id")
        .agg(F.count(F.lit(1)).alias("records"), F.max(F.struct("record_id", "gross_c", "order_date")).alias("last"))
        .filter("records > 1"))
    return twice.join(paid, ["merchant_id", "order_id"]).select(
        F.lit("ledger_record").alias("entity_type"), F.lit("").alias("settlement_id"), "order_id",
        F.col("last.gross_c").alias("net_c"), F.col("last.order_date").alias("settlement_date"),
        F.format_string(texts.LEDGER_DUPLICATE_FORMAT, "records", "payments", F.col("records") - 1).alias("reason"))


def exception_register(leg_exceptions: DataFrame, ledger_exceptions: DataFrame) -> DataFrame:
    return leg_exceptions.unionByName(ledger_exceptions)


def ledger_first(ledger: DataFrame) -> DataFrame:
    """First ledger row of each order by record ID, aggregated before the shuffle."""
    first = F.min(F.struct(F.coalesce("record_id", F.lit("")).alias("record_id"), "customer", "gross_c", "order_date", "status"))
    return ledger.groupBy("merchant_id", "order_id").agg(first.alias("f")).select("merchant_id", "order_id", "f.*")
