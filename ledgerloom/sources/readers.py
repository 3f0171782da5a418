"""Read and conform the sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import (
    as_bool, as_date, blank_to, epoch_date, from_minor, id_set, map_type, money, net_minor, recon_amount, to_cents,
)
from ledgerloom.sources import runs, schema as S


def read_source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A source as text columns, in the schema's names, whatever its column order.

    Columns the file lacks stay absent for ``with_defaults`` to fill.
    """
    if fmt == "csv":
        df = spark.read.option("header", True).option("multiLine", False).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(f.name).cast("string") for f in schema if f.name in df.columns])


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns that are absent as literals."""
    return df.withColumns({
        name: value if not isinstance(value, (str, int, float, bool, type(None))) else F.lit(value)
        for name, value in defaults.items() if name not in df.columns})


def _complete(df: DataFrame, schema: T.StructType, cfg: MatchConfig) -> DataFrame:
    known = S.defaults(cfg)
    filled = with_defaults(df, {f.name: F.lit(known.get(f.name)).cast("string") for f in schema})
    return filled.withColumns({
        name: blank_to(name, value) for name, value in known.items() if name in schema.fieldNames()})


def _cents(amount: Column, text: str) -> Column:
    """Cents of an amount; a blank one is zero, a malformed one null (see ``rejected_rows``)."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return F.when(blank, F.lit(0).cast("bigint")).otherwise(to_cents(amount))


def rejected_rows(df: DataFrame, source: str, id_col: str, amounts: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """(source, row_id, column, raw): every given value that is no amount or no date.

    Such a value is null in the conformed table, so the row matches nothing
    and no total counts it as zero.
    """
    def bad(name: str, parsed: Column) -> Column:
        given = F.trim(F.coalesce(F.col(name), F.lit(""))) != ""
        return F.when(given & parsed.isNull(), F.struct(F.lit(name).alias("column"), F.col(name).alias("raw")))

    present = set(df.columns)
    found = [bad(n, money(n)) for n in amounts if n in present] + [bad(n, as_date(n)) for n in dates if n in present]
    return (
        df.select(F.lit(source).alias("source"), F.col(id_col).alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("bad"))
        .select("source", "row_id", "bad.column", "bad.raw"))


#: Amount and date columns of each source, for ``rejected_rows``.
CHECKED = {
    "order_ledger": ("order_id", ["gross_amount"], ["order_date"]),
    "settlements": ("settlement_id", ["gross_amount", "fee", "tax", "net_amount", "expected_bank_amount"], ["settlement_date"]),
    "bank": ("bank_txn_id", ["amount"], ["value_date"]),
}


def conform_settlements(df: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    full = _complete(df, S.SETTLEMENT, cfg)
    return full.select(
        "settlement_id", F.coalesce("order_id", F.lit("")).alias("order_id"), "merchant_id", "payment_rail", "currency", "type",
        *[_cents(money(c), c).alias(f"{n}_c")
          for c, n in (("gross_amount", "gross"), ("fee", "fee"), ("tax", "tax"), ("net_amount", "net"))],
        F.when(F.trim(F.coalesce("expected_bank_amount", F.lit(""))) == "", _cents(money("net_amount"), "net_amount"))
        .otherwise(to_cents(money("expected_bank_amount"))).alias("recon_c"),
        (F.trim(F.coalesce("expected_bank_amount", F.lit(""))) != "").alias("has_expected"),
        "source_amount", "exchange_rate", as_date("settlement_date").alias("settlement_date"))


def conform_bank(df: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return _complete(df, S.BANK, cfg).select(
        "bank_txn_id", "merchant_id", "payment_rail", "currency",
        _cents(money("amount"), "amount").alias("amount_c"), as_date("value_date").alias("value_date"),
        F.coalesce("narration", F.lit("")).alias("narration"))


def conform_ledger(df: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return _complete(df, S.LEDGER, cfg).select(
        F.coalesce("order_id", F.lit("")).alias("order_id"), "merchant_id", "customer",
        to_cents(money("gross_amount")).alias("gross_c"), as_date("order_date").alias("order_date"), "status", "record_id")


def conform_truth(df: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    full = _complete(df, S.TRUTH, cfg)
    ids = blank_to("expected_bank_ids", "")
    matched = F.when(F.col("expected_outcome").isNotNull(), F.col("expected_outcome") == "RECONCILED").otherwise(as_bool("should_match"))
    return full.select(
        "settlement_id",
        F.array_join(id_set(F.when(ids != "", ids).otherwise(F.col("true_bank_txn_ids"))), ";").alias("expected_bank_ids"),
        matched.alias("should_match"), F.when(matched, "RECONCILED").otherwise("EXCEPTION").alias("expected_outcome"),
        "case_type")


def flatten_settlement_json(payloads: DataFrame) -> DataFrame:
    """Processor payload items as settlement source rows."""
    item = payloads.select(F.explode("items").alias("i")).select("i.*")
    return item.select(
        F.coalesce("entity_id", "id").alias("settlement_id"),
        F.coalesce(F.nullif("order_receipt", F.lit("")), F.nullif("order_id", F.lit("")), F.lit("UNKNOWN_ORDER")).alias("order_id"),
        *[from_minor(c).cast("string").alias(n) for c, n in (("amount", "gross_amount"), ("fee", "fee"), ("tax", "tax"))],
        from_minor(net_minor("credit", "debit")).cast("string").alias("net_amount"),
        epoch_date("settled_at", "created_at").cast("string").alias("settlement_date"),
        map_type("type").alias("type"), F.coalesce("currency", F.lit("INR")).alias("currency"))


def read_settlement_json(spark: SparkSession, path: str) -> DataFrame:
    return flatten_settlement_json(spark.read.schema(S.PAYLOAD).option("multiLine", True).json(path))


def read_table(spark: SparkSession, warehouse: str, table: str) -> DataFrame:
    """The rows of committed runs; all rows of a table that knows no runs."""
    df = spark.read.parquet(f"{warehouse}/{table}")
    if "run_id" not in df.columns:
        return df
    return df.filter(F.col("run_id").isin([c.run_id for c in runs.commits(spark, warehouse)])).drop("run_id")


def table_exists(spark: SparkSession, warehouse: str, table: str) -> bool:
    return runs.exists(spark, f"{warehouse}/{table}")


def ingest_labels(spark: SparkSession, path: str, run_date: str) -> DataFrame | None:
    """Reviewer labels stamped with the run date, or None where there are none."""
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    filled = with_defaults(df, {f.name: F.lit(None).cast("string") for f in S.LABELS})
    return filled.select(*S.LABELS.fieldNames(), F.lit(run_date).cast("date").alias("event_date"))
