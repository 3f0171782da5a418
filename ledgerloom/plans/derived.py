"""Reconciliation tables derived from the ``orders`` table.

A deterministic rule in integer cents turns each order into a ledger row, its
settlement legs and its bank lines, so the work grows with the orders read.
The rule is stated once, as SQL expressions both Spark and an ANSI engine
evaluate alike; Spark expands it in one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_EIGHTH = "cast(floor(k / 8) as bigint)"

BASE_STEPS = (
    """SELECT o_orderkey AS k,
  concat('M', cast(cast(floor(o_custkey / 50) as bigint) as string)) AS merchant_id,
  concat('C', cast(o_custkey as string)) AS customer,
  case when o_orderkey % 10 < 8 then 'RAIL_A' else 'RAIL_B' end AS payment_rail,
  case o_orderkey % 9 when 3 then concat('ORD-', cast(o_orderkey as string))
    when 5 then concat('ord.', cast(o_orderkey as string), '/A') else concat('ORD', cast(o_orderkey as string)) end AS order_id,
  cast(round(o_totalprice * 100) as bigint) AS c,
  cast(o_orderdate as date) AS od
FROM {orders}""",
    """SELECT *, 20000 + (k % 7) * (k % 7) * 12500 + c % 400 AS gross_c
FROM {prev} AS b0""",
    "SELECT *, cast(floor((2 * gross_c + 50) / 100) as bigint) AS fee_c FROM {prev} AS b1",
    "SELECT *, cast(floor((18 * fee_c + 50) / 100) as bigint) AS tax_c FROM {prev} AS b2",
    """SELECT *, gross_c - fee_c - tax_c AS net_c,
  od + cast(case when k % 13 = 0 then 7 + k % 3 else 1 + k % 2 end as int) AS sd,
  (k % 5) * (k % 3) % 3 AS lag_days,
  case when k % 8 = 1 then """ + _EIGHTH + """ % 6 * 95 - 240 else 0 end AS noise_c,
  case when k % 20 < 13 then concat('NEFT/RAIL/', order_id, '/SETL') else 'RAIL SETTLEMENT CR' end AS credit_text,
  case when k % 20 < 13 then concat('NEFT/RAIL/REFUND/', order_id) else 'RAIL REFUND DR' end AS debit_text,
  case when k % 14 = 6 then 'missing' when k % 40 = 11 then 'adjustment' when k % 40 = 13 then 'split_payment'
    when k % 60 = 20 then 'ambiguous' when k % 25 = 4 and k % 2 = 0 then 'split_bank'
    when k % 41 = 7 then 'fx' else 'normal' end AS kind
FROM {prev} AS b3""",
    """SELECT *, cast(floor(60 * net_c / 100) as bigint) AS first_c,
  cast(floor(45 * net_c / 100) as bigint) AS part_c,
  cast(floor(gross_c / 10) as bigint) AS tenth_c,
  cast(floor(30 * gross_c / 100) as bigint) AS third_c,
  cast(floor((8333 * net_c + 50) / 100) as bigint) AS fx_c
FROM {prev} AS b4""",
)

# (id suffix, condition, net cents, days after settlement date, type)
LEGS = (
    ("1", "kind <> 'split_payment'", "net_c", "0", "'settlement'"),
    ("1", "kind = 'split_payment'", "first_c", "0", "'split_payment'"),
    ("2", "kind = 'split_payment'", "net_c - first_c", "0", "'split_payment'"),
    ("3", "k % 17 = 5", "net_c", "0", "'duplicate_settlement'"),
    ("4", "k % 25 = 3", "-gross_c", "1 + k % 4", "'refund'"),
    ("5", "k % 25 = 4", "-third_c", "1 + k % 4", "'partial_refund'"),
    ("6", "k % 50 = 10", "-gross_c", "9", "'chargeback'"),
    ("7", "kind = 'adjustment'", "-tenth_c", "0", "'settlement_adjustment'"),
    ("8", "k % 40 = 12", "20000", "1", "'cashback_adjustment'"),
)

_WIDE = "k % 23 = 2"

# (id suffix, condition, cents, days after settlement date, narration, leg suffixes it settles)
LINES = (
    ("1", "kind in ('normal', 'fx')",
     "case when kind = 'fx' then fx_c else net_c end + noise_c + case when " + _WIDE + " then 600 else 0 end",
     "lag_days + case when " + _WIDE + " then 3 else 0 end", "credit_text", "1"),
    ("1", "kind = 'adjustment'", "net_c - tenth_c", "lag_days", "'RAIL SETTLEMENT CR'", "1+7"),
    ("1", "kind = 'split_payment'", "first_c", "lag_days", "credit_text", "1"),
    ("2", "kind = 'split_payment'", "net_c - first_c", "lag_days", "credit_text", "2"),
    ("1", "kind = 'split_bank'", "part_c", "lag_days", "concat(credit_text, '/PART')", "1"),
    ("2", "kind = 'split_bank'", "net_c - part_c", "lag_days", "concat(credit_text, '/PART')", "1"),
    ("4", "k % 25 = 3 and k % 10 <> 8", "-gross_c", "1 + k % 4 + k % 3", "debit_text", "4"),
    ("5", "k % 25 = 4", "-third_c", "1 + k % 4 + k % 3", "debit_text", "5"),
    ("6", "k % 50 = 10", "-gross_c", "9 + k % 3", "debit_text", "6"),
    ("8", "k % 40 = 12", "20000", "1 + k % 3", "credit_text", "8"),
    ("9", "kind = 'ambiguous'", "net_c", "1", "'RAIL MISC CR A'", ""),
    ("10", "kind = 'ambiguous'", "net_c", "1", "'RAIL MISC CR B'", ""),
    ("11", "k % 70 = 9", "40000 + c % 30000", "2", "'COUNTER DEPOSIT'", ""),
)


def base_sql(orders: str) -> str:
    text = BASE_STEPS[0].format(orders=orders)
    for step in BASE_STEPS[1:]:
        text = step.format(prev=f"({text})")
    return text


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    # the rule below multiplies every order, so the orders are spread first
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return spark.sql(base_sql("{src}"), src=orders)


def _expand(df: DataFrame, keep: list[str], branches: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """One row per branch whose condition holds, with that branch's columns."""
    numbers = F.array(*[F.when(F.expr(condition), F.lit(i)) for i, (condition, _) in enumerate(branches)])
    rows = df.withColumn("_branch", F.explode(numbers)).filter("_branch IS NOT NULL")

    def choose(name: str):
        by_text: dict[str, list[int]] = {}
        for i, (_, columns) in enumerate(branches):
            by_text.setdefault(columns[name], []).append(i)
        texts = sorted(by_text, key=lambda text: len(by_text[text]))
        cases = "".join(f" WHEN _branch IN ({', '.join(map(str, by_text[t]))}) THEN {t}" for t in texts[:-1])
        return F.expr(f"CASE{cases} ELSE {texts[-1]} END" if cases else texts[-1]).alias(name)

    return rows.select(*keep, *[choose(name) for name in branches[0][1]])


def _text(suffix: str, prefix: str) -> str:
    return f"concat('{prefix}', cast(k as string), '-{suffix}')"


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement legs in the engine's columns."""
    branches = []
    for suffix, condition, net, days, kind in LEGS:
        main = suffix == "1" and kind == "'settlement'"
        fx = "kind = 'fx'" if main else "1 = 0"
        branches.append((condition, {
            "settlement_id": _text(suffix, "SETL"),
            "type": f"cast({kind} as string)",
            "currency": f"case when {fx} then 'USD' else 'INR' end",
            "gross_c": "cast(gross_c as bigint)" if main else f"cast({net} as bigint)",
            "fee_c": "cast(fee_c as bigint)" if main else "cast(0 as bigint)",
            "tax_c": "cast(tax_c as bigint)" if main else "cast(0 as bigint)",
            "net_c": f"cast({net} as bigint)",
            "recon_c": f"cast(case when {fx} then fx_c else {net} end as bigint)",
            "has_expected": f"cast({fx} as boolean)",
            "source_amount": f"case when {fx} then cast(net_c as string) end",
            "exchange_rate": f"case when {fx} then '83.33' end",
            "settlement_date": f"sd + cast({days} as int)",
        }))
    return _expand(base(spark, sf_dir), ["order_id", "merchant_id", "payment_rail"], branches)


def _line_branches():
    return [
        (condition, {
            "bank_txn_id": _text(suffix, "BANK"),
            "amount_c": f"cast({cents} as bigint)",
            "value_date": f"sd + cast({days} as int)",
            "narration": f"cast({narration} as string)",
            "settles": f"cast('{settles}' as string)",
        })
        for suffix, condition, cents, days, narration, settles in LINES
    ]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank lines in the engine's columns."""
    out = _expand(base(spark, sf_dir), ["merchant_id", "payment_rail"], _line_branches())
    return out.withColumn("currency", F.lit("INR")).drop("settles")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ledger; some orders are entered twice."""
    columns = {
        "gross_c": "gross_c", "order_date": "od",
        "status": "case when k % 50 = 10 then 'chargeback' when k % 25 = 3 then 'refunded' "
                  "when k % 25 = 4 then 'partial_refund' else 'paid' end",
    }
    branches = [("1 = 1", {**columns, "record_id": "concat('L', cast(k as string), '-1')"}),
                ("k % 80 = 15", {**columns, "record_id": "concat('L', cast(k as string), '-2')"})]
    return _expand(base(spark, sf_dir), ["order_id", "merchant_id", "customer"], branches)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the lines that settle each leg, empty where there are none."""
    known = _expand(base(spark, sf_dir), ["k"], _line_branches()).filter("settles <> ''")
    per_leg = (
        known.select(F.explode(F.split("settles", "\\+")).alias("suffix"), "k", "bank_txn_id")
        .groupBy(F.concat(F.lit("SETL"), F.col("k"), F.lit("-"), F.col("suffix")).alias("settlement_id"))
        .agg(F.array_join(F.array_sort(F.collect_set("bank_txn_id")), ";").alias("expected_bank_ids")))
    all_legs = _expand(base(spark, sf_dir), ["order_id"], [
        (condition, {"settlement_id": _text(suffix, "SETL")}) for suffix, condition, *_ in LEGS])
    return (
        all_legs.join(per_leg, "settlement_id", "left")
        .select("settlement_id", F.coalesce("expected_bank_ids", F.lit("")).alias("expected_bank_ids"),
                F.col("expected_bank_ids").isNotNull().alias("should_match"))
        .withColumn("expected_outcome", F.when(F.col("should_match"), "RECONCILED").otherwise("EXCEPTION")))
