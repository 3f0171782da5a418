"""The full cascade: exact ID, fuzzy, split, then lifecycle on what is left.

Both directions run in one pass, since the direction is a join key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import cents_text, decision, is_fx
from ledgerloom.operators.matching import exact_id_match, fuzzy_match, lifecycle_match, split_match
from ledgerloom.operators.pools import one_per_id, open_legs, open_lines
from ledgerloom.runtime import durable, scratch

_STAGES = (exact_id_match, fuzzy_match, split_match, lifecycle_match)


class Stages:
    """Links per stage, each run once; a stage sees what its predecessors left open."""

    def __init__(self, legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT):
        # a leg and a line take part once, however often they were delivered
        self.legs, self.lines, self.cfg = durable(one_per_id(legs, "settlement_id")), durable(one_per_id(lines, "bank_txn_id")), cfg
        self._open = (self.legs, self.lines)
        self._found: list[DataFrame] = []

    def upto(self, count: int) -> list[DataFrame]:
        while len(self._found) < count:
            if self._found:
                # written, since a stage reads its rows several times
                legs, lines = self._open
                self._open = durable(open_legs(legs, self._found[-1])), durable(open_lines(lines, self._found[-1]))
            with scratch():
                links = durable(_STAGES[len(self._found)](*self._open, self.cfg), keep=True)
            self._found.append(links)
        return self._found[:count]

    def all(self) -> list[DataFrame]:
        return self.upto(len(_STAGES))


def union_links(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def describe(links: DataFrame, legs: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Decisions: links with their order, match type, tier and note."""
    fx = is_fx("currency", cfg)
    kind = (
        F.when((F.col("stage") == "exact") & fx, texts.FX).when(F.col("stage") == "exact", texts.EXACT)
        .when(F.col("stage") == "fuzzy", texts.FUZZY).when(F.col("stage") == "split", texts.SPLIT)
        .when(F.col("stage") == "lifecycle", texts.LIFECYCLE).otherwise(F.col("stage")))
    info = legs.select("settlement_id", "order_id", "merchant_id", "type", "currency", "recon_c", "net_c",
                       "source_amount", "exchange_rate", "settlement_date")
    return (
        links.join(info, "settlement_id")
        .withColumn("match_type", kind)
        .withColumn("notes", match_note(cfg))
        .withColumn("decision", decision("confidence_pct", cfg))
        .select("settlement_id", "order_id", "merchant_id", "match_type", "bank_ids", "confidence_pct",
                "amount_diff_c", "decision", "notes", "settlement_date"))


def match_note(cfg: MatchConfig = DEFAULT):
    role = F.when(F.col("type").isin(*texts.BASE_TYPES), "base leg").otherwise(
        F.replace("type", F.lit("_"), F.lit(" ")))
    blank = F.lit("")
    return (
        F.when(F.col("match_type") == texts.FX, F.concat(
            F.lit("Converted: "), F.coalesce("source_amount", blank), F.lit(" "), "currency",
            F.lit(" times "), F.coalesce("exchange_rate", blank), F.lit(" is ₹"),
            cents_text("recon_c"), F.lit(", and the narration names the order.")))
        .when(F.col("match_type") == texts.EXACT, texts.NOTE_EXACT)
        .when(F.col("match_type") == texts.FUZZY, F.concat(
            F.lit("Best open line by amount (off by ₹"), cents_text("amount_diff_c"),
            F.lit(") and day (off by "), F.col("day_diff").cast("string"), F.lit(").")))
        .when(F.col("match_type") == texts.SPLIT, texts.NOTE_SPLIT)
        .when(F.col("match_type") == texts.LIFECYCLE, F.concat(
            F.lit("Part of an order paid in one credit: "), role, F.lit("."))))


@dataclass
class Reconciliation:
    """Result tables of one run."""

    legs: DataFrame
    lines: DataFrame
    decisions: DataFrame

    @property
    def unresolved(self) -> DataFrame:
        return open_legs(self.legs, self.decisions)

    @property
    def unexplained(self) -> DataFrame:
        return open_lines(self.lines, self.decisions)


def reconcile(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> Reconciliation:
    return finish(Stages(legs, lines, cfg))


def finish(stages: Stages, keep: bool = False) -> Reconciliation:
    links = union_links(stages.all())
    decisions = durable(describe(links, stages.legs, stages.cfg), keep=keep)
    return Reconciliation(stages.legs, stages.lines, decisions)
