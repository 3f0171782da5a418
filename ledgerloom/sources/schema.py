"""Columns of the raw sources and the defaults of optional ones.

Every source column is read as text; ``conform`` casts it.
"""

from pyspark.sql import types as T

from ledgerloom.config import MatchConfig


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


LEDGER = _text("order_id", "customer", "gross_amount", "order_date", "status", "record_id", "merchant_id", "currency")
SETTLEMENT = _text(
    "settlement_id", "order_id", "gross_amount", "fee", "tax", "net_amount", "settlement_date", "type", "currency",
    "source_amount", "exchange_rate", "expected_bank_amount", "merchant_id", "payment_rail")
BANK = _text("bank_txn_id", "amount", "value_date", "narration", "merchant_id", "payment_rail", "currency")
TRUTH = _text("settlement_id", "true_bank_txn_ids", "should_match", "expected_bank_ids", "expected_outcome", "case_type")
LABELS = _text("settlement_id", "approved", "actual_bank_txn_id", "reviewer", "reviewed_at")

_ITEM = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("entity_id", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("order_receipt", T.StringType()), T.StructField("order_id", T.StringType()),
    T.StructField("amount", T.LongType()), T.StructField("credit", T.LongType()), T.StructField("debit", T.LongType()),
    T.StructField("fee", T.LongType()), T.StructField("tax", T.LongType()),
    T.StructField("settled_at", T.LongType()), T.StructField("created_at", T.LongType()),
    T.StructField("currency", T.StringType()),
])
PAYLOAD = T.StructType([T.StructField("items", T.ArrayType(_ITEM))])


def defaults(cfg: MatchConfig) -> dict[str, str]:
    return {"merchant_id": cfg.default_merchant, "payment_rail": cfg.default_rail, "currency": cfg.home_currency}
