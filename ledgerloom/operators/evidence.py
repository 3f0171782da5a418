"""Evidence-ranked matching: mutual best, candidate audit, review queue.

Candidates are ranked by ID evidence first, then cost, then identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import direction, is_fx, names_order
from ledgerloom.operators.cells import cells
from ledgerloom.operators.matching import amount_date_edges, named_pairs, said
from ledgerloom.operators.ranks import ranked
from ledgerloom.runtime import durable

_SCOPE = ["merchant_id", "payment_rail", "direction"]
_LEG_KEYS = [*_SCOPE, "leg_currency", "has_expected", "recon_c", "settlement_date"]
_LINE_KEYS = [*_SCOPE, "line_currency", "amount_c", "value_date"]


def matchable(legs: DataFrame) -> DataFrame:
    return legs.filter(F.col("type").isin(*texts.MATCHABLE_TYPES))


def _legs(legs: DataFrame) -> DataFrame:
    return (
        matchable(legs).withColumn("direction", direction("recon_c")).filter("direction <> 0")
        .select("settlement_id", F.upper("order_id").alias("ref"), *_SCOPE,
                F.col("currency").alias("leg_currency"), "has_expected", "recon_c", "settlement_date"))


def _lines(lines: DataFrame) -> DataFrame:
    return (
        lines.withColumn("direction", direction("amount_c")).filter("direction <> 0")
        .select("bank_txn_id", *_SCOPE, F.col("currency").alias("line_currency"), "amount_c", "value_date",
                said()))


def evidence_edges(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Every candidate edge with its evidence; the audit product."""
    has_id = names_order("said", "ref")
    return (
        amount_date_edges(_legs(legs), _lines(lines), cfg).withColumn("has_id", has_id)
        .select("settlement_id", "bank_txn_id", "merchant_id", "leg_currency", "amount_diff_c", "day_diff",
                "cost_c", "has_id"))


def _order(other: str) -> list[Column]:
    return [(~F.col("has_id")).alias("no_id"), F.col("cost_c"), F.col(other)]


def candidate_ranks(edges: DataFrame) -> DataFrame:
    """Rank of each edge among its leg's and among its line's candidates, however many these are."""
    marked = edges.withColumn("_no_id", ~F.col("has_id"))
    by_leg = ranked(marked, ["settlement_id"], ["_no_id", "cost_c", "bank_txn_id"], "settlement_rank")
    return ranked(by_leg, ["bank_txn_id"], ["_no_id", "cost_c", "settlement_id"], "bank_rank").drop("_no_id")


def edge_audit(edges: DataFrame) -> DataFrame:
    """Every edge, selected or rejected and why.

    Only "is it the best" is needed, so the best is aggregated before the
    shuffle and joined back instead of sorting each candidate group.
    """
    def best(of, other):
        return edges.groupBy(of).agg(F.min(F.struct(*_order(other))).alias("b")).select(
            of, F.col(f"b.{other}").alias(f"best_{other}"))

    by_leg = F.col("bank_txn_id") == F.col("best_bank_txn_id")
    by_line = F.col("settlement_id") == F.col("best_settlement_id")
    return (
        edges.join(best("settlement_id", "bank_txn_id"), "settlement_id")
        .join(best("bank_txn_id", "settlement_id"), "bank_txn_id")
        .withColumns({
            "selected_by_settlement": by_leg,
            "selected_by_bank": by_line,
            "candidate_disposition": F.when(by_leg & by_line, "SELECTED").otherwise("REJECTED"),
            "rejection_reason": F.when(~by_leg, texts.REJECTED_BY_LEG).when(~by_line, texts.REJECTED_BY_LINE)})
        .drop("best_bank_txn_id", "best_settlement_id"))


def _mutual(edges: DataFrame) -> DataFrame:
    """Edges that are the best of both their ends."""
    mine = edges.groupBy("left").agg(F.min(F.struct("cost_c", "right", "amount_diff_c", "day_diff")).alias("b")).select(
        "left", "b.*")
    theirs = edges.groupBy("right").agg(F.min(F.struct("cost_c", "left")).alias("b")).select("right", "b.left")
    return mine.join(theirs, ["left", "right"])


def _repeats(*sides: tuple[DataFrame, str, str]) -> list[bool]:
    """Whether rows of a side share an identifier, or a row lacks it or its currency."""
    ids = None
    for number, (rows, id_col, currency) in enumerate(sides):
        own = rows.select(F.lit(number).alias("side"), F.col(id_col).alias("id"), F.col(currency).isNull().alias("bare"))
        ids = own if ids is None else ids.unionByName(own)
    counted = ids.groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"), F.max("bare").alias("bare"))
    bad = {row["side"] for row in counted.filter("n > 1 OR id IS NULL OR bare").select("side").distinct().collect()}
    return [number in bad for number in range(len(sides))]


def mutual_best(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT, edges: DataFrame | None = None) -> DataFrame:
    """Links whose leg and line rank each other first.

    All legs of a cell prefer the same line, and that line prefers the
    smallest of them, so only the smallest identifiers of two cells can be
    each other's best. Cells and minima decide everything; no pair of rows is
    ever listed. A leg or line with any ID evidence takes part only through
    its evidence edges. Where ``evidence_edges`` of these legs and lines are
    listed anyway, ``edges`` takes them, and they are not searched again.
    """
    leg_rows, line_rows = _legs(legs), _lines(lines)
    repeats = _repeats((leg_rows, "settlement_id", "leg_currency"), (line_rows, "bank_txn_id", "line_currency"))
    if edges is not None and not any(repeats):
        return _graded(_mutual_edges(edges), legs, cfg)
    plain = durable(_cell_pairs(leg_rows, line_rows, cfg))
    evidence = _evidence(plain, leg_rows, line_rows, cfg)

    def known(rows, keys, id_col, cell, repeated):
        """Identifiers of rows with ID evidence, at least of those that name a cell."""
        named = evidence.select(cell).distinct()
        if not repeated:  # the row that names a cell also names the part of it with the same order ID or narration
            return named
        parts = cells(rows, keys, id_col, cell, "n").join(named, cell, "left_semi")
        return rows.join(parts, keys, "left_semi").select(F.col(id_col).alias(cell))

    unproven = (
        _mutual(plain)
        .join(known(leg_rows.filter("ref <> ''"), [*_LEG_KEYS, "ref"], "settlement_id", "left", repeats[0]), "left", "left_anti")
        .join(known(line_rows, [*_LINE_KEYS, "said"], "bank_txn_id", "right", repeats[1]), "right", "left_anti")
        .withColumn("has_id", F.lit(False)))
    links = _mutual(evidence).withColumn("has_id", F.lit(True)).unionByName(unproven)
    return _graded(links.withColumnsRenamed({"left": "settlement_id", "right": "bank_txn_id"}), legs, cfg)


def _mutual_edges(edges: DataFrame) -> DataFrame:
    """Edges of rows with distinct identifiers that are the best of both their ends."""
    mine = edges.groupBy("settlement_id").agg(
        F.min(F.struct(*_order("bank_txn_id"), "amount_diff_c", "day_diff")).alias("b")).select("settlement_id", "b.*")
    theirs = edges.groupBy("bank_txn_id").agg(F.min(F.struct(*_order("settlement_id"))).alias("b")).select(
        "bank_txn_id", "b.settlement_id")
    return mine.join(theirs, ["settlement_id", "bank_txn_id"]).withColumn("has_id", ~F.col("no_id")).drop("no_id")


_PAIR = ["left", "right", "cost_c", "amount_diff_c", "day_diff"]


def _cell_pairs(leg_rows: DataFrame, line_rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Candidate cells by amount and day, with their evidence where it is one for all their rows.

    A pair is ``open`` if the rows of one of its cells differ in order ID or
    narration; only such a pair keeps the keys of its cells.
    """
    def told(rows, keys, id_col, cell, text):
        return rows.groupBy(*keys).agg(
            F.min(id_col).alias(cell), F.min(F.coalesce(text, F.lit(""))).alias(text),
            F.max(F.coalesce(text, F.lit(""))).alias("_last")).withColumn(f"{cell}_mixed", F.col(text) != F.col("_last")).drop("_last")

    pairs = amount_date_edges(
        told(leg_rows, _LEG_KEYS, "settlement_id", "left", "ref"), told(line_rows, _LINE_KEYS, "bank_txn_id", "right", "said"), cfg)
    is_open = F.col("left_mixed") | F.col("right_mixed")
    keys = dict.fromkeys([*_LEG_KEYS, *_LINE_KEYS])
    return pairs.select(
        *_PAIR, is_open.alias("open"), (~is_open & names_order("said", "ref")).alias("has_id"),
        *[F.when(is_open, F.col(k)).alias(k) for k in keys])


def _evidence(plain: DataFrame, leg_rows: DataFrame, line_rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs with ID evidence; in open pairs of cells, rows meet by order ID and narration."""
    from ledgerloom.functions.scalars import cost_cents

    def parts(rows, keys, text, id_col, cell):
        wanted = durable(plain.filter("open").select(*[F.col(k).alias(f"_of_{k}") for k in keys]).distinct())
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        condition = same[0]
        for other in same[1:]:
            condition = condition & other
        # written first: else the words of all narrations are split below the join, to drop rows without any
        near = durable(rows.join(wanted, condition, "left_semi").select(*keys, text, id_col))
        return cells(near, [*keys, text], id_col, cell, f"{cell}_n")

    found = (
        named_pairs(parts(leg_rows.filter("ref <> ''"), _LEG_KEYS, "ref", "settlement_id", "left"),
                    parts(line_rows, _LINE_KEYS, "said", "bank_txn_id", "right"), cfg.fuzzy_cents, cfg.fuzzy_days)
        .withColumn("cost_c", cost_cents("amount_diff_c", "day_diff", cfg)))
    return plain.filter("has_id").select(*_PAIR).unionByName(durable(found.select(*_PAIR)))


def _graded(links: DataFrame, legs: DataFrame, cfg: MatchConfig) -> DataFrame:
    exact = F.col("has_id") & (F.col("amount_diff_c") <= cfg.tight_cents) & (F.col("day_diff") <= cfg.tight_days)
    scale = cfg.cost_scale_cents
    raw = F.floor((F.lit(scale) - F.col("cost_c")) * 10000 / scale)
    info = legs.select("settlement_id", "order_id", "merchant_id", "currency", "settlement_date")
    return (
        links.join(info, "settlement_id")
        .withColumns({
            "match_type": F.when(is_fx("currency", cfg), texts.FX).when(exact, texts.EXACT).otherwise(texts.FUZZY),
            "confidence_bp": F.when(exact, cfg.exact_pct * 100).otherwise(
                F.greatest(F.lit(cfg.floor_pct * 100), raw)).cast("bigint"),
            "decision": F.when(exact | (F.col("cost_c") <= cfg.raw_cost_cut), texts.AUTO).otherwise(texts.REVIEW)})
        .select("settlement_id", "bank_txn_id", "order_id", "merchant_id", "match_type", "confidence_bp", "decision",
                "amount_diff_c", "day_diff", "cost_c", "has_id", "settlement_date"))


def candidate_sets(edges: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Candidate count and the cheapest few candidates of each leg.

    Ranked and cut before collecting, so no array exceeds the queue size.
    """
    rank = F.row_number().over(Window.partitionBy("settlement_id").orderBy("cost_c", "bank_txn_id"))
    top = (
        edges.withColumn("rank", rank).filter(F.col("rank") <= cfg.queue_candidates)
        .groupBy("settlement_id")
        .agg(F.array_sort(F.collect_list(
            F.struct("cost_c", "bank_txn_id", "amount_diff_c", "day_diff", "has_id"))).alias("top_candidates")))
    counts = edges.groupBy("settlement_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    return counts.join(top, "settlement_id")


def review_queue(sets: DataFrame, decisions: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Review matches and undecided legs with competing candidates."""
    needed = (F.col("decision") == texts.REVIEW) | (F.col("decision").isNull() & (F.col("candidate_count") > 1))
    return (
        sets.join(decisions.select("settlement_id", "decision"), "settlement_id", "left")
        .filter(needed)
        .withColumns({"queue_reason": F.lit(texts.QUEUE_REASON), "model_version": F.lit("not-invoked"),
                      "policy_version": F.lit(cfg.policy_version), "decision": F.lit(texts.REVIEW)}))


def review_batch(queue: DataFrame, size: int) -> DataFrame:
    """The next ``size`` queue items; a top-n, not a full sort."""
    return queue.orderBy("event_date", "settlement_id").limit(size)


def preview(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(size)


def coarse_exceptions(legs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Undecided legs with one of three reasons."""
    reason = None
    for kind, text in texts.COARSE_BY_TYPE.items():
        hit = F.col("type") == kind
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    return (
        legs.join(decisions.select("settlement_id"), "settlement_id", "left_anti")
        .select("settlement_id", "order_id", "merchant_id", "net_c", "settlement_date", "type",
                F.lit(texts.EXCEPTION).alias("decision"), reason.otherwise(texts.COARSE_OTHER).alias("reason")))


def evidence_json() -> Column:
    """Evidence of an edge as a JSON document, for the audit sink."""
    return F.to_json(F.struct(
        "merchant_id", F.col("leg_currency").alias("currency"),
        F.col("amount_diff_c").alias("amount_difference_c"), F.col("day_diff").alias("date_difference"),
        F.col("has_id").alias("order_id_in_narration"), F.col("cost_c").alias("candidate_score_c")))
