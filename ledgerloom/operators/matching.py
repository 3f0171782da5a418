"""The matching stages of the cascade: exact ID, fuzzy, split, lifecycle.

Every stage is: cells of both sides -> candidate cells by band join -> greedy
assignment -> links. Stages read only rows still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import confidence_pct, cost_cents, fx_admissible, names_order, ref_key, ref_tokens
from ledgerloom.operators.bands import band_join
from ledgerloom.operators.cells import cells
from ledgerloom.operators import twosum
from ledgerloom.operators.greedy import assign, expand
from ledgerloom.operators.pools import one_line_links, with_direction
from ledgerloom.runtime import durable

_SCOPE = ["merchant_id", "payment_rail", "direction"]
_LEG_KEYS = [*_SCOPE, "leg_currency", "has_expected", "recon_c", "settlement_date"]
_LINE_KEYS = [*_SCOPE, "line_currency", "amount_c", "value_date"]


def _info():
    return F.struct("amount_diff_c", "day_diff").alias("info")


def leg_pool(legs: DataFrame) -> DataFrame:
    pool = with_direction(legs, "net_c")
    return pool.select(
        "settlement_id", F.upper("order_id").alias("ref"), *_SCOPE,
        F.col("currency").alias("leg_currency"), "has_expected", "recon_c", "settlement_date")


def line_pool(lines: DataFrame, *extra) -> DataFrame:
    pool = with_direction(lines, "amount_c")
    return pool.select(
        "bank_txn_id", *_SCOPE, F.col("currency").alias("line_currency"), "amount_c", "value_date", *extra)


def _settle(candidates, leg_rows, leg_keys, line_rows, line_keys, pairs=False):
    return assign(
        candidates, (leg_rows, leg_keys, "settlement_id", "left", "left_n"),
        (line_rows, line_keys, "bank_txn_id", "right", "right_n"), pairs)


def said():
    return F.upper(F.coalesce("narration", F.lit(""))).alias("said")


# ---- exact ID -----------------------------------------------------------

def reference_edges(leg_cells: DataFrame, line_cells: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Leg and line meet where the narration names the order and both
    tolerances hold. Joined on one word of the order ID; only such pairs are
    searched for the whole ID."""
    return named_pairs(leg_cells, line_cells, cfg.tight_cents, cfg.tight_days)


def named_pairs(leg_cells: DataFrame, line_cells: DataFrame, cents: int, days: int) -> DataFrame:
    # a word of an order ID tells rows apart by itself, so its blocks may be wide
    legs = leg_cells.withColumn("word", ref_key("ref")).filter("word IS NOT NULL")
    lines = line_cells.withColumn("word", F.explode(ref_tokens("said")))
    return band_join(
        legs, lines, [*_SCOPE, "word"], "recon_c", "settlement_date", "amount_c", "value_date", cents, days, wide=8,
    ).filter(fx_admissible("leg_currency", "line_currency", "has_expected") & names_order("said", "ref"))


def exact_id_candidates(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Every leg and line pair with ID evidence inside the tight tolerance."""
    edges = reference_edges(leg_pool(legs), line_pool(lines, said()), cfg)
    return edges.select("settlement_id", "bank_txn_id", "amount_diff_c", "day_diff")


def exact_id_match(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    leg_rows, leg_keys = leg_pool(legs), [*_LEG_KEYS, "ref"]
    line_rows, line_keys = line_pool(lines, said()), [*_LINE_KEYS, "said"]
    leg_cells = cells(leg_rows, leg_keys, "settlement_id", "left", "left_n")
    line_cells = cells(line_rows, line_keys, "bank_txn_id", "right", "right_n")
    candidates = (
        reference_edges(leg_cells, line_cells, cfg)
        .select(F.lit(0).cast("bigint").alias("cost"), "left", "left_n", "right", "right_n", _info()))
    chosen = _settle(candidates, leg_rows, leg_keys, line_rows, line_keys)
    return one_line_links(chosen, "exact", F.lit(cfg.exact_pct))


# ---- fuzzy amount and date ----------------------------------------------

def amount_date_edges(left: DataFrame, right: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Candidate edges of the fuzzy band with their cost; sides may be rows or cells."""
    joined = band_join(
        left, right, _SCOPE, "recon_c", "settlement_date", "amount_c", "value_date",
        cfg.fuzzy_cents, cfg.fuzzy_days)
    return (
        joined.filter(fx_admissible("leg_currency", "line_currency", "has_expected"))
        .withColumn("cost_c", cost_cents("amount_diff_c", "day_diff", cfg)))


def candidate_edges(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return amount_date_edges(leg_pool(legs), line_pool(lines), cfg).select(
        "settlement_id", "bank_txn_id", "amount_diff_c", "day_diff", "cost_c")


def _fuzzy_cells(legs, lines, cfg):
    leg_rows, line_rows = leg_pool(legs), line_pool(lines)
    leg_cells = cells(leg_rows, _LEG_KEYS, "settlement_id", "left", "left_n")
    line_cells = cells(line_rows, _LINE_KEYS, "bank_txn_id", "right", "right_n")
    edges = amount_date_edges(leg_cells, line_cells, cfg).select(
        "cost_c", "left", "left_n", "right", "right_n", "amount_diff_c", "day_diff")
    return leg_rows, leg_cells, line_rows, line_cells, edges


def _with_tie(edges: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Mark cells whose second-best line costs at most the tie gap more.

    A leg cell has at most one edge per distinct amount and day in its band,
    so the window is small however many rows the cells hold.
    """
    cell = Window.partitionBy("left")
    near = F.col("cost_c") <= F.min("cost_c").over(cell) + cfg.tie_gap_cents
    return edges.withColumn("near", near).withColumn(
        "tied", F.sum(F.when(F.col("near"), F.col("right_n")).otherwise(0)).over(cell) > 1)


def ambiguous_settlements(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Legs whose best two candidates are within the tie gap."""
    leg_rows, leg_cells, _, _, edges = _fuzzy_cells(legs, lines, cfg)
    tied = _with_tie(edges, cfg).filter("tied").select("left").distinct()
    keys = leg_cells.join(tied, "left", "left_semi").select(*_LEG_KEYS)
    return leg_rows.join(keys, _LEG_KEYS, "left_semi").select("settlement_id")


def fuzzy_match(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    leg_rows, _, line_rows, _, edges = _fuzzy_cells(legs, lines, cfg)
    candidates = (
        _with_tie(edges, cfg)
        .filter(~F.col("tied") & (F.col("cost_c") <= cfg.fuzzy_cost_cut))
        .select(F.col("cost_c").alias("cost"), "left", "left_n", "right", "right_n", _info()))
    chosen = _settle(candidates, leg_rows, _LEG_KEYS, line_rows, _LINE_KEYS)
    return one_line_links(chosen, "fuzzy", confidence_pct("cost", cfg))


# ---- split: one leg, two lines ------------------------------------------

def _blocks(df, amount, day, width, days, names):
    return df.withColumns({
        names[0]: F.floor(F.abs(amount) / width),
        names[1]: F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / (2 * days + 1)),
    })


def _block_days(day_block):
    return F.explode(F.array(F.col(day_block) - 1, F.col(day_block), F.col(day_block) + 1))


def split_edges(leg_cells: DataFrame, line_cells: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Triples leg = line + line within tolerance, both lines near the leg.

    Found in two steps. First over blocks of amounts and days: which blocks
    hold a leg, a line and a line of the complementary amount. The number of
    block pairs depends on the spread of amounts, not on the number of rows.
    Only rows of such block triples are then joined.
    """
    width, days = cfg.split_cents, cfg.split_days
    scope = _SCOPE
    legs = _blocks(leg_cells, F.col("recon_c"), "settlement_date", width, days, ("_a", "_d"))
    lines = _blocks(line_cells, F.col("amount_c"), "value_date", width, days, ("_a", "_d"))
    line_blocks = lines.select(*scope, "_a", "_d").distinct()
    first = line_blocks.select(*scope, F.col("_a").alias("_a1"), F.col("_d").alias("_d1"))
    second = line_blocks.select(*scope, F.col("_a").alias("_a2"), F.col("_d").alias("_d2"))
    ordered = (F.col("_a1") < F.col("_a2")) | ((F.col("_a1") == F.col("_a2")) & (F.col("_d1") <= F.col("_d2")))
    triples = (
        legs.select(*scope, "_a", "_d").distinct()
        .withColumn("_d1", _block_days("_d"))
        .join(first, [*scope, "_d1"])
        # The first line is the smaller one, so it is at most half the leg.
        .filter(F.col("_a1") * 2 <= F.col("_a") + 2)
        .withColumn("_a2", F.explode(F.sequence(F.col("_a") - F.col("_a1") - 2, F.col("_a") - F.col("_a1") + 1)))
        .withColumn("_d2", _block_days("_d"))
        .filter(ordered)
        .join(second, [*scope, "_a2", "_d2"])
    )
    line = {name: F.col(name) for name in ("line_currency", "amount_c", "value_date", "right", "right_n")}

    def side(number):
        return lines.select(*scope, F.col("_a").alias(f"_a{number}"), F.col("_d").alias(f"_d{number}"),
                            *[column.alias(f"{name}{number}") for name, column in line.items()])

    near = [F.abs(F.datediff(F.col(f"value_date{i}"), F.col("settlement_date"))) <= days for i in (1, 2)]
    admissible = [fx_admissible("leg_currency", f"line_currency{i}", "has_expected") for i in (1, 2)]
    one_block = (F.col("_a1") == F.col("_a2")) & (F.col("_d1") == F.col("_d2"))
    distinct_pair = F.when(F.col("right1") == F.col("right2"), F.col("right_n1") > 1).otherwise(
        ~one_block | (F.col("right1") < F.col("right2")))
    gap = F.abs(F.col("amount_c1") + F.col("amount_c2") - F.col("recon_c"))
    return (
        legs.join(triples, [*scope, "_a", "_d"])
        .join(side(1), [*scope, "_a1", "_d1"]).filter(near[0] & admissible[0])
        .join(side(2), [*scope, "_a2", "_d2"]).filter(near[1] & admissible[1])
        .withColumn("amount_diff_c", gap)
        .filter((F.col("amount_diff_c") <= cfg.split_cents) & distinct_pair)
        .withColumn("day_diff", F.greatest(
            *[F.abs(F.datediff(F.col(f"value_date{i}"), F.col("settlement_date"))) for i in (1, 2)]))
    )


def split_candidates(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Every (leg, lower line, higher line) whose sum is within tolerance."""
    unit = F.lit(1).cast("bigint")
    leg_rows = leg_pool(legs).withColumns({"left": F.col("settlement_id"), "left_n": unit})
    line_rows = line_pool(lines).withColumns({"right": F.col("bank_txn_id"), "right_n": unit})
    return split_edges(leg_rows, line_rows, cfg).select(
        "settlement_id", F.least("right1", "right2").alias("first_bank_id"),
        F.greatest("right1", "right2").alias("second_bank_id"), "amount_diff_c")


def split_match(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Legs paid by two lines, chosen over a two-sum index; triples are never stored."""
    leg_rows, line_rows = leg_pool(legs), line_pool(lines)
    leg_cells = durable(cells(leg_rows, _LEG_KEYS, "settlement_id", "left", "left_n"))
    line_cells = durable(cells(line_rows, _LINE_KEYS, "bank_txn_id", "right", "right_n"))
    segments = twosum.choose(split_edges(leg_cells, line_cells, cfg), leg_cells, line_cells, cfg)
    chosen = expand(
        segments, (leg_rows, _LEG_KEYS, "settlement_id", "left", "left_n"),
        (line_rows, _LINE_KEYS, "bank_txn_id", "right", "right_n"), pairs=True)
    return chosen.select(
        F.col("left_id").alias("settlement_id"),
        F.array_sort(F.array("right_id", "right_id2")).alias("bank_ids"),
        F.lit("split").alias("stage"), F.lit(cfg.split_pct).cast("bigint").alias("confidence_pct"),
        F.col("info.amount_diff_c"), F.col("info.day_diff"))


# ---- lifecycle: base leg and adjustments as one line ---------------------

_GROUP = ["merchant_id", "payment_rail", "currency", "order_id"]


def lifecycle_groups(legs: DataFrame) -> DataFrame:
    """Orders with one base leg and at least one adjustment, with their total.

    Counts and sums only, so an order of any size is one small row.
    """
    base = F.col("type").isin(*texts.BASE_TYPES)
    adjustment = F.col("type").isin(*texts.ADJUSTMENT_TYPES)
    return (
        legs.filter((base | adjustment) & (F.trim("order_id") != "")).groupBy(*_GROUP).agg(
            F.sum("net_c").alias("expected_c"), F.count_if(base).alias("base_legs"),
            F.count_if(adjustment).alias("adjustment_legs"),
            F.max(F.when(base, F.col("settlement_id"))).alias("base_id"),
            F.max(F.when(base, F.col("net_c"))).alias("base_net_c"),
            F.max(F.when(base, F.col("settlement_date"))).alias("settlement_date"))
        .filter("base_legs = 1 AND adjustment_legs > 0"))


def _group_id():
    return F.concat_ws("|", "order_id", "merchant_id", "payment_rail", "currency")


_GROUP_KEYS = ["merchant_id", "payment_rail", "currency", "expected_c", "settlement_date"]


def _group_edges(groups, lines, cfg):
    return band_join(
        groups, lines, ["merchant_id", "payment_rail", "currency"],
        "expected_c", "settlement_date", "amount_c", "value_date", cfg.tight_cents, cfg.tight_days)


def _credit_lines(lines):
    return lines.filter("amount_c > 0").select(
        "bank_txn_id", "merchant_id", "payment_rail", "currency", "amount_c", "value_date")


def lifecycle_candidates(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    groups = lifecycle_groups(legs)
    return _group_edges(groups, _credit_lines(lines), cfg).select(
        "order_id", "merchant_id", "bank_txn_id", "expected_c", "value_date", "amount_diff_c", "day_diff")


def lifecycle_match(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    groups = durable(lifecycle_groups(legs).withColumn("settlement_id", _group_id()))
    line_rows = _credit_lines(lines)
    line_keys = ["merchant_id", "payment_rail", "currency", "amount_c", "value_date"]
    group_cells = cells(groups, _GROUP_KEYS, "settlement_id", "left", "left_n")
    line_cells = cells(line_rows, line_keys, "bank_txn_id", "right", "right_n")
    candidates = (
        _group_edges(group_cells, line_cells, cfg)
        .select(F.lit(0).cast("bigint").alias("cost"), "left", "left_n", "right", "right_n", _info()))
    chosen = _settle(candidates, groups, _GROUP_KEYS, line_rows, line_keys)
    won = (
        groups.join(chosen.select(F.col("left_id").alias("settlement_id"), "right_id", "info"), "settlement_id")
        .select(*_GROUP, "right_id", "info"))
    kinds = [*texts.BASE_TYPES, *texts.ADJUSTMENT_TYPES]
    return (
        legs.filter(F.col("type").isin(*kinds)).select("settlement_id", *_GROUP).join(won, _GROUP)
        .select("settlement_id", F.array("right_id").alias("bank_ids"), F.lit("lifecycle").alias("stage"),
                F.lit(cfg.lifecycle_pct).cast("bigint").alias("confidence_pct"),
                F.col("info.amount_diff_c"), F.col("info.day_diff")))
