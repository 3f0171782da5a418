"""DuckDB text of the derived tables, built from the same rule as the Spark side."""

from __future__ import annotations

import re

from ledgerloom.plans import derived

_WORD = re.compile(r"\w+")


def _union(branches, keep):
    return "\nUNION ALL\n".join(
        "SELECT " + ", ".join([*keep, *[f"{sql} AS {name}" for name, sql in columns.items()]])
        + f" FROM base WHERE {condition}"
        for condition, columns in branches)


def _legs_sql() -> str:
    branches = []
    for suffix, condition, net, days, kind in derived.LEGS:
        main = suffix == "1" and kind == "'settlement'"
        fx = "kind = 'fx'" if main else "1 = 0"
        branches.append((condition, {
            "settlement_id": f"'SETL' || k || '-{suffix}'",
            "type": kind,
            "currency": f"CASE WHEN {fx} THEN 'USD' ELSE 'INR' END",
            "gross_c": "gross_c" if main else f"({net})::BIGINT",
            "fee_c": "fee_c" if main else "0::BIGINT",
            "tax_c": "tax_c" if main else "0::BIGINT",
            "net_c": f"({net})::BIGINT",
            "recon_c": f"(CASE WHEN {fx} THEN fx_c ELSE {net} END)::BIGINT",
            "has_expected": f"({fx})",
            "source_amount": f"CASE WHEN {fx} THEN net_c::VARCHAR END",
            "exchange_rate": f"CASE WHEN {fx} THEN '83.33' END",
            "settlement_date": f"sd + ({days})::INT",
        }))
    return _union(branches, ["k", "order_id", "merchant_id", "payment_rail"])


def _lines_sql() -> str:
    return _union([
        (condition, {
            "bank_txn_id": f"'BANK' || k || '-{suffix}'",
            "currency": "'INR'",
            "amount_c": f"({cents})::BIGINT",
            "value_date": f"sd + ({days})::INT",
            "narration": narration,
            "settles": f"'{settles}'",
        }) for suffix, condition, cents, days, narration, settles in derived.LINES
    ], ["k", "merchant_id", "payment_rail"])


_LEDGER = """SELECT k, order_id, merchant_id, customer, gross_c, od AS order_date,
  CASE WHEN k % 50 = 10 THEN 'chargeback' WHEN k % 25 = 3 THEN 'refunded'
       WHEN k % 25 = 4 THEN 'partial_refund' ELSE 'paid' END AS status,
  'L' || k || '-' || n AS record_id
FROM base, (VALUES (1), (2)) v(n) WHERE n = 1 OR k % 80 = 15"""

_TRUTH = """SELECT l.settlement_id, l.order_id, l.type, l.settlement_date, l.net_c,
  coalesce(x.ids, '') AS expected_bank_ids, x.ids IS NOT NULL AS should_match,
  CASE WHEN x.ids IS NULL THEN 'EXCEPTION' ELSE 'RECONCILED' END AS expected_outcome
FROM legs l LEFT JOIN (
  SELECT 'SETL' || k || '-' || suffix AS settlement_id, string_agg(bank_txn_id, ';' ORDER BY bank_txn_id) AS ids
  FROM (SELECT k, bank_txn_id, unnest(string_split(settles, '+')) AS suffix FROM lines WHERE settles <> '')
  GROUP BY 1) x USING (settlement_id)"""


def with_tables(body: str, *ctes: tuple[str, str]) -> str:
    """``body`` with the derived tables in scope, plus further named tables."""
    named = [
        ("base", derived.base_sql("orders")),
        ("legs", _legs_sql()),
        ("lines", _lines_sql()),
        ("ledger", _LEDGER),
        ("truth", _TRUTH),
        *ctes,
    ]
    used = _needed(body, named)
    if not used:
        return body
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in used) + "\n" + body


def _needed(body: str, named):
    """The named tables that ``body`` uses, directly or through others."""
    words = set(_WORD.findall(body))
    keep = []
    for name, sql in reversed(named):
        if name in words:
            keep.append((name, sql))
            words |= set(_WORD.findall(sql))
    return list(reversed(keep))
