"""An incremental evidence run against an append-only warehouse.

Replays are dropped, decided legs and used lines stay out, and every table is
appended with its version stamps. A second run over the same input decides
nothing again.

What a run decided is also kept as two key tables, fingerprints by leg day and
used line IDs. A run opens those of earlier runs with the same leg days or an
overlapping range of line IDs, so what it reads follows its input and not the
history. Exceptions are a register: a row opens one, a later row closes it
when the leg, or another version of it, is matched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import cents_text, stamp
from ledgerloom.operators import evidence, exceptions, ranker, replay, review
from ledgerloom.operators.matching import lifecycle_match, split_match
from ledgerloom.operators.pools import one_per_id, open_legs, open_lines, repeated_ids
from ledgerloom.operators.summary import run_counters
from ledgerloom.runtime import durable, scratch
from ledgerloom.sources import readers as R, runs, schema as S, writers as W

# Two versions of a leg may be open at once, so a leg is known by its ID and
# its fingerprint; the ID comes first and keeps the order.
_KEY_TAIL = 64


def _keyed(legs: DataFrame) -> DataFrame:
    return legs.withColumn("settlement_id", F.concat(
        "settlement_id", F.lit("#"), "event_hash"))


def _plain_id(df: DataFrame, keep_key: bool = False) -> DataFrame:
    if keep_key:
        df = df.withColumn("settlement_key", F.col("settlement_id"))
    return df.withColumn("settlement_id", F.expr(f"left(settlement_id, length(settlement_id) - {_KEY_TAIL + 1})"))


_DECISION = ["event_hash", "settlement_id", "order_id", "merchant_id", "bank_ids", "match_type", "confidence_bp",
             "decision", "reason", "settlement_date"]


def read_inputs(spark: SparkSession, folder: str, names: dict[str, str], cfg: MatchConfig = DEFAULT) -> dict[str, DataFrame]:
    """Conformed ledger, legs and lines from the CSV files of a folder, and their ``rejected`` values."""
    ledger, legs, lines = (
        R.read_source(spark, f"{folder}/{names[n]}", schema)
        for n, schema in (("ledger", S.LEDGER), ("legs", S.SETTLEMENT), ("lines", S.BANK)))
    rejected = [R.rejected_rows(raw, source, *R.CHECKED[source])
                for raw, source in ((ledger, "order_ledger"), (legs, "settlements"), (lines, "bank"))]
    return {
        "ledger": R.conform_ledger(ledger, cfg), "legs": R.conform_settlements(legs, cfg), "lines": R.conform_bank(lines, cfg),
        "rejected": rejected[0].unionByName(rejected[1]).unionByName(rejected[2])}


def evidence_decisions(legs: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(decisions, candidate edges): lifecycle, then mutual best, then split."""
    cycle = durable(lifecycle_match(legs, lines, cfg))
    legs_left, lines_left = durable(open_legs(legs, cycle)), durable(open_lines(lines, cycle))
    mutual = durable(evidence.mutual_best(legs_left, lines_left, cfg))
    taken = mutual.select("settlement_id", F.array("bank_txn_id").alias("bank_ids"))
    tight = cfg.with_(split_cents=cfg.tight_cents, split_days=cfg.fuzzy_days)
    split = durable(split_match(
        open_legs(evidence.matchable(legs_left), taken), open_lines(lines_left, taken), tight))
    info = legs.select("event_hash", "settlement_id", "order_id", "merchant_id", "recon_c", "settlement_date",
                       "currency", "source_amount", "exchange_rate")
    blank = F.lit("")
    fx_reason = F.concat(F.lit("Expected amount given for "), F.coalesce("source_amount", blank), F.lit(" "), "currency",
                         F.lit(" converted at "), F.coalesce("exchange_rate", blank))
    one = (
        mutual.select("settlement_id", "bank_txn_id", "match_type", "confidence_bp", "decision").join(info, "settlement_id")
        .withColumns({
            "bank_ids": F.array("bank_txn_id"),
            "reason": F.when(F.col("match_type") == texts.FX, fx_reason)
            .when(F.col("match_type") == texts.EXACT, "The narration names the order; amount and day fit.")
            .otherwise("Mutually best by amount and day, without the order's ID.")}))

    def grouped(links, kind, reason):
        return links.join(info, "settlement_id").withColumns({
            "match_type": F.lit(kind), "confidence_bp": F.col("confidence_pct") * 100,
            "decision": F.when(F.col("confidence_pct") >= cfg.auto_accept_pct, texts.AUTO).otherwise(texts.REVIEW),
            "reason": reason})

    decisions = (
        one.select(*_DECISION)
        .unionByName(grouped(split, texts.SPLIT, F.concat(
            F.lit("Two lines add up to the leg's ₹"), cents_text("recon_c"))).select(*_DECISION))
        .unionByName(grouped(cycle, texts.LIFECYCLE, F.lit(
            "Base leg and adjustments together equal one credit.")).select(*_DECISION)))
    return decisions, evidence.evidence_edges(legs_left, lines_left, cfg)


def run(
    spark: SparkSession,
    inputs: dict[str, DataFrame],
    warehouse: str,
    run_date: str,
    cfg: MatchConfig = DEFAULT,
    write: bool = True,
    labels_path: str | None = None,
    replies: DataFrame | None = None,
    model: ranker.Ranker | None = None,
) -> dict[str, DataFrame]:
    """One increment; returns its tables. With ``write=False`` nothing is appended.

    ``inputs`` has ledger, legs and lines, and optionally ``rejected`` (see
    ``readers.rejected_rows``): legs named there are reported and not matched.
    ``replies`` (settlement_id, raw) pass the gate against this run's queue,
    ``model`` scores the queue's candidates.

    A run's rows are visible after its last write (see ``sources.runs``). A run
    that dies before has decided nothing, so the next one finds the same rows.
    The stage tables of the run are deleted at its end, the returned ones not.
    """
    known = runs.commits(spark, warehouse)
    record = runs.Commit(uuid.uuid4().hex, known[-1].seq + 1 if known else 1)
    with scratch():
        out, touched = _tables(spark, inputs, warehouse, run_date, cfg, labels_path, replies, model, known, record.seq)
        out = {name: durable(df, keep=True) for name, df in out.items()}
    if write:
        for name in sorted(out, key=lambda name: name == "reconciliation_decisions"):
            W.append(out[name].withColumn("run_id", F.lit(record.run_id)), warehouse, name)
        runs.commit(spark, warehouse, runs.Commit(record.run_id, record.seq, *touched))
    return out


def _bounds(df: DataFrame, column: str) -> tuple[str | None, str | None]:
    return tuple(df.agg(F.min(column).cast("string"), F.max(column).cast("string")).first())


def _undecided(spark, warehouse, known, legs, lines, days, line_ids):
    """Legs without a decision and lines not used yet, from the key tables of the runs that can hold them."""
    decided = runs.rows_of(spark, warehouse, "decided_keys", runs.sharing_days(known, *days))
    if decided is not None:
        same_days = decided.filter(F.col("key_day").between(*[F.lit(d).cast("date") for d in days])).join(
            legs.select(F.col("settlement_date").alias("key_day")).distinct(), "key_day", "left_semi")
        legs = replay.increment(legs, same_days)
    used = runs.rows_of(spark, warehouse, "used_lines", runs.sharing_lines(known, *line_ids))
    if used is not None:
        in_range = used.filter(F.col("bank_txn_id").between(*line_ids))
        lines = lines.join(in_range.select("bank_txn_id").distinct(), "bank_txn_id", "left_anti")
    return legs, lines


def open_exceptions(spark: SparkSession, warehouse: str) -> DataFrame:
    """The register as it stands: exceptions whose last row is an opening one."""
    rows = R.read_table(spark, warehouse, "reconciliation_exceptions")
    return rows.groupBy("event_hash").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*").filter(
        F.col("state") == texts.OPEN)


def _tables(spark, inputs, warehouse, run_date, cfg, labels_path, replies, model, known, seq):
    legs, leg_replays = replay.dedup_events(inputs["legs"], replay.LEG_EVENT, "settlement_event")
    lines, line_replays = replay.dedup_events(inputs["lines"], replay.LINE_EVENT, "bank_event")
    day = F.lit(run_date).cast("date")

    def dated(df, **versions):
        return stamp(df, **versions).withColumn("event_date", day)

    rejected = inputs.get("rejected")
    if rejected is not None:
        rejected = durable(rejected)
        legs = legs.join(rejected.filter("source = 'settlements'").select(F.col("row_id").alias("settlement_id")), "settlement_id", "left_anti")
    repeated = repeated_ids(lines, "bank", "bank_txn_id")
    lines = one_per_id(lines, "bank_txn_id")
    legs, lines = durable(legs), durable(lines)
    days, line_ids = _bounds(legs, "settlement_date"), _bounds(lines, "bank_txn_id")
    if known:
        legs, lines = _undecided(spark, warehouse, known, legs, lines, days, line_ids)
    elif R.table_exists(spark, warehouse, "reconciliation_decisions"):
        prior = R.read_table(spark, warehouse, "reconciliation_decisions").select("event_hash", "bank_ids")
        legs, lines = replay.increment(legs, prior), open_lines(lines, prior)
    legs, lines = durable(_keyed(legs)), durable(lines)
    found, edges = evidence_decisions(legs, lines, cfg)
    decisions = durable(dated(found, rule_version=cfg.rule_version))
    audit = durable(dated(
        evidence.edge_audit(edges).withColumn("feature_evidence", evidence.evidence_json()),
        rule_version=cfg.rule_version, blocking_version=cfg.blocking_version))
    unresolved = evidence.coarse_exceptions(legs, decisions).join(
        legs.select("settlement_id", "event_hash"), "settlement_id")
    queue = durable(evidence.review_queue(evidence.candidate_sets(audit, cfg), decisions, cfg).join(
        legs.select("settlement_id", "event_hash", "order_id", "merchant_id"), "settlement_id"))
    register = dated(_plain_id(unresolved), rule_version=cfg.rule_version).withColumns(
        {"state": F.lit(texts.OPEN), "seq": F.lit(seq).cast("long")})
    used = decisions.select(F.explode("bank_ids").alias("bank_txn_id")).distinct()
    out = {
        "candidate_edges": _plain_id(audit, keep_key=True),
        "ingestion_deduplication": dated(leg_replays.unionByName(line_replays)),
        "reconciliation_decisions": _plain_id(decisions),
        "reconciliation_exceptions": register,
        "ai_review_queue": dated(_plain_id(queue)),
        "ledger_exceptions": dated(exceptions.repeated_orders(inputs["ledger"])),
        "duplicate_ids": dated(repeated),
        "decided_keys": decisions.select("event_hash", F.col("settlement_date").alias("key_day")),
        "used_lines": used,
    }
    if rejected is not None:
        out["rejected_rows"] = dated(rejected)
    if replies is not None:
        out["ai_recommendations"] = dated(review.gate_recommendations(replies, _plain_id(queue), cfg))
    if model is not None:
        out["candidate_scores"] = dated(_plain_id(ranker.score_queue(model, queue)))
    labels = R.ingest_labels(spark, labels_path, run_date) if labels_path else None
    if labels is not None:
        out["review_labels"] = labels
    # Rows that an earlier run recorded are not recorded again. Rows of a leg lie in runs with its day.
    keys = {"reconciliation_exceptions": ["event_hash"], "ai_review_queue": ["event_hash"],
            "candidate_edges": ["settlement_key", "bank_txn_id"],
            "ledger_exceptions": ["merchant_id", "order_id", "records"], "duplicate_ids": ["source", "row_id", "copies"],
            "rejected_rows": ["source", "row_id", "column", "raw"],
            "ingestion_deduplication": ["event_hash", "copy", "event_date"], "review_labels": ["settlement_id", "event_date"]}
    same_days = runs.sharing_days(known, *days)
    for name, key in keys.items():
        if name not in out or not R.table_exists(spark, warehouse, name):
            continue
        by_leg = known and name in ("reconciliation_exceptions", "ai_review_queue", "candidate_edges")
        seen = runs.rows_of(spark, warehouse, name, same_days) if by_leg else R.read_table(spark, warehouse, name)
        if seen is None:
            continue
        if "event_date" in key:
            seen = seen.filter(F.col("event_date") == day)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
        condition = same[0]
        for other in same[1:]:
            condition = condition & other
        out[name] = out[name].alias("n").join(seen.select(*key).alias("o"), condition, "left_anti")
    if known and R.table_exists(spark, warehouse, "reconciliation_exceptions"):
        out["reconciliation_exceptions"] = out["reconciliation_exceptions"].unionByName(
            _closed(open_exceptions(spark, warehouse), _plain_id(decisions), day, seq, cfg), allowMissingColumns=True)
    taken = durable(used)
    return out, (*days, *_bounds(taken, "bank_txn_id"))


def _closed(register: DataFrame, decisions: DataFrame, day, seq: int, cfg: MatchConfig) -> DataFrame:
    """Closing rows: the leg itself was matched now, or another version of it."""
    own = decisions.select("event_hash", F.lit(texts.RESOLVED).alias("now"))
    other = decisions.select("merchant_id", "settlement_id", F.lit(texts.SUPERSEDED).alias("later")).distinct()
    return (
        register.join(own, "event_hash", "left").join(other, ["merchant_id", "settlement_id"], "left")
        .withColumn("state", F.coalesce("now", "later")).filter("state IS NOT NULL").drop("now", "later")
        .withColumns({"event_date": day, "seq": F.lit(seq).cast("long"), "rule_version": F.lit(cfg.rule_version)}))


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    return run_counters(tables)
