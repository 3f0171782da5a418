"""The registered queries: each operator over the derived tables of a folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT as CFG
from ledgerloom.functions import scalars as X
from ledgerloom.operators import evaluation, evidence, exceptions, matching, ranker, replay, review, story, summary
from ledgerloom.operators.greedy import greedy_match, links_of_cells, unit_candidates
from ledgerloom.operators.pools import repeated_ids, with_direction
from ledgerloom.operators.rematch import rematch
from ledgerloom.plans import derived
from ledgerloom.plans.cascade import Reconciliation, Stages, finish
from ledgerloom.runtime import durable
from ledgerloom.sources import readers
from ledgerloom.sources.schema import defaults

RUN_DATE = "2024-01-01"


class Tables:
    """Source tables and results of one folder, each written once when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def legs(self) -> DataFrame:
        return durable(derived.legs(self.spark, self.sf_dir))

    @cached_property
    def lines(self) -> DataFrame:
        return durable(derived.lines(self.spark, self.sf_dir))

    @cached_property
    def ledger(self) -> DataFrame:
        return durable(derived.ledger(self.spark, self.sf_dir))

    @cached_property
    def truth(self) -> DataFrame:
        return durable(derived.truth(self.spark, self.sf_dir))

    @cached_property
    def stages(self) -> Stages:
        return Stages(self.legs, self.lines)

    @cached_property
    def run(self) -> Reconciliation:
        return finish(self.stages)

    @cached_property
    def edges(self) -> DataFrame:
        return durable(evidence.evidence_edges(self.legs, self.lines))

    @cached_property
    def mutual(self) -> DataFrame:
        """Legs that are matched, with their decision; from the candidate edges where these are listed already."""
        found = evidence.mutual_best(self.legs, self.lines, edges=self.__dict__.get("edges"))
        return durable(found.select("settlement_id", "decision"))

    @cached_property
    def leg_exceptions(self) -> DataFrame:
        return durable(exceptions.classify_exceptions(self.run.unresolved, self.lines))

    @cached_property
    def status(self) -> DataFrame:
        return durable(story.leg_status(self.legs, self.run.decisions, self.leg_exceptions))

    @cached_property
    def ledger_rows(self) -> DataFrame:
        return exceptions.ledger_first(self.ledger)

    @cached_property
    def verdicts(self) -> DataFrame:
        return durable(story.verdicts(self.ledger_rows, self.status))

    @cached_property
    def queue(self) -> DataFrame:
        return durable(evidence.review_queue(evidence.candidate_sets(self.edges), self.mutual))

    @property
    def orders(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/orders.parquet")


_known: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _known:
        _known[key] = Tables(spark, sf_dir)
    return _known[key]


def forget(results_only: bool = True) -> None:
    """Drop remembered results, so that a timed query computes them itself."""
    for item in _known.values():
        for name in ("stages", "run", "edges", "mutual", "leg_exceptions", "status", "verdicts", "queue"):
            item.__dict__.pop(name, None)
    if not results_only:
        _known.clear()


QUERIES: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tables(spark, sf_dir))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _joined(col) -> Column:
    return F.array_join(col, "+")


# ---- sources and scalars -------------------------------------------------

@query
def rejected_rows(t):
    """Amounts with signs or grouping and dates of another form, found before they turn into nothing."""
    raw = t.legs.select(
        "settlement_id",
        F.when(F.col("net_c") % 97 == 0, F.concat(F.lit("₹"), X.cents_text("net_c"))).otherwise(X.cents_text("net_c")).alias("net_amount"),
        F.when(F.col("gross_c") % 89 == 0, F.lit("01/03/2024")).otherwise(F.col("settlement_date").cast("string")).alias("settlement_date"))
    return readers.rejected_rows(raw, "settlements", "settlement_id", ["net_amount", "fee"], ["settlement_date"])


@query
def duplicate_ids(t):
    """Lines of which some were delivered again, or with another amount."""
    again = t.lines.filter("amount_c % 31 = 0").unionByName(t.lines.filter("amount_c % 62 = 0").withColumn("amount_c", F.col("amount_c") + 1))
    return repeated_ids(t.lines.unionByName(again), "bank", "bank_txn_id")


@query
def source_scan(t):
    """Settlement legs written as text and conformed back."""
    raw = t.legs.select(
        "settlement_id", "order_id", "merchant_id", "payment_rail", "type",
        X.cents_text("gross_c").alias("gross_amount"), X.cents_text("fee_c").alias("fee"), X.cents_text("tax_c").alias("tax"),
        X.cents_text("net_c").alias("net_amount"), F.col("settlement_date").cast("string").alias("settlement_date"),
        F.when(F.col("currency") == "INR", " ").otherwise(F.col("currency")).alias("currency"),
        F.when(F.col("has_expected"), X.cents_text("recon_c")).otherwise("").alias("expected_bank_amount"))
    return readers.conform_settlements(raw).drop("source_amount", "exchange_rate")


@query
def conform_defaults(t):
    bare = t.ledger.select("record_id", "order_id")
    return readers.with_defaults(bare, defaults(CFG))


def _price_text():
    return (F.when(F.col("o_orderkey") % 5 == 0, "  ").when(F.col("o_orderkey") % 5 == 1, "n/a")
            .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("5 "))))


@query
def money_quantise(t):
    return t.orders.select("o_orderkey", X.to_cents(X.money(_price_text())).alias("amount_c"),
                           X.as_date(F.when(F.col("o_orderkey") % 5 == 1, "2024-13-41").otherwise(
                               F.col("o_orderdate").cast("date").cast("string"))).alias("order_date"))


@query
def blank_default(t):
    status = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 1, "  ").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", X.blank_to(status, "default").alias("status"))


@query
def recon_amount(t):
    expected = F.when(F.col("has_expected"), X.cents_text("recon_c")).otherwise(" ")
    return t.legs.select("settlement_id", X.to_cents(X.recon_amount(X.cents_text("net_c"), expected)).alias("recon_c"))


@query
def block_keys(t):
    return summary.block_keys(t.legs, "recon_c", "settlement_date").select("settlement_id", "amount_bucket", "date_bucket")


@query
def narration_normalise(t):
    return t.lines.select("bank_txn_id", X.norm_text("narration").alias("narration_normalized"))


@query
def narration_tokens(t):
    return t.lines.select("bank_txn_id", F.array_join(X.ref_tokens("narration"), " ").alias("tokens"))


@query
def event_fingerprint(t):
    return replay.with_fingerprint(t.legs, replay.LEG_EVENT).select("settlement_id", "event_hash")


@query
def bank_id_sets(t):
    doubled = F.concat_ws("+", F.lit(""), "expected_bank_ids", "expected_bank_ids", F.lit("ZZ"))
    return t.truth.select("settlement_id", _joined(X.id_set(doubled)).alias("bank_ids"),
                          F.size(X.id_set("expected_bank_ids")).cast("bigint").alias("n"),
                          X.as_bool(F.when(F.col("should_match"), " YES").otherwise("no")).alias("matched"))


def _minor(t):
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    stamp = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + k % 86400
    return t.orders.select(
        F.col("o_orderkey").alias("k"), F.when(k % 3 != 0, cents).alias("credit"), F.when(k % 3 == 0, cents).alias("debit"),
        F.when(k % 4 == 1, 0).when(k % 4 > 1, stamp).cast("bigint").alias("settled_at"), (stamp + 86400).alias("created_at"),
        F.when(k % 5 == 0, "payment").when(k % 5 == 1, "refund").when(k % 5 == 2, "adjustment").when(k % 5 == 3, "transfer").alias("type"))


@query
def minor_units(t):
    return _minor(t).select("k", X.to_cents(X.from_minor(X.net_minor("credit", "debit"))).alias("net_c"),
                            X.epoch_date("settled_at", "created_at").alias("settlement_date"))


@query
def type_mapping(t):
    return _minor(t).select("k", X.map_type("type").alias("type"))


@query
def fee_derivation(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    fee = X.fee_cents(cents)
    tax = X.tax_cents(fee)
    return t.orders.select("o_orderkey", fee.alias("fee_c"), tax.alias("tax_c"), (cents - fee - tax).alias("net_c"))


@query
def confidence_score(t):
    return t.edges.select("settlement_id", "bank_txn_id", X.confidence_pct("cost_c").alias("confidence_pct"))


@query
def match_labels(t):
    return t.run.decisions.select("settlement_id", "match_type", "notes")


@query
def leg_labels(t):
    return t.legs.select("settlement_id", X.leg_label("type").alias("label"))


@query
def exception_category(t):
    return (t.leg_exceptions.select(X.exception_category("reason").alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("exceptions")))


@query
def match_type_display(t):
    return t.run.decisions.select("settlement_id", X.pretty_type("match_type").alias("display_name"))


@query
def direction_pools(t):
    return with_direction(t.legs, "net_c").groupBy("direction").agg(
        F.count(F.lit(1)).alias("legs"), F.sum("net_c").alias("net_c"))


# ---- candidates ----------------------------------------------------------

@query
def exact_id_candidates(t):
    return matching.exact_id_candidates(t.legs, t.lines)


@query
def candidate_edges(t):
    return matching.candidate_edges(t.legs, t.lines)


@query
def candidate_ranks(t):
    return evidence.candidate_ranks(t.edges).select(
        "settlement_id", "bank_txn_id", "has_id", "cost_c", "settlement_rank", "bank_rank")


@query
def candidate_sets(t):
    top = F.transform("top_candidates", lambda c: F.concat(c["cost_c"].cast("string"), F.lit(":"), c["bank_txn_id"]))
    return evidence.candidate_sets(t.edges).select("settlement_id", "candidate_count", F.array_join(top, " ").alias("top"))


@query
def ambiguous_settlements(t):
    return matching.ambiguous_settlements(t.legs, t.lines)


@query
def lifecycle_groups(t):
    return matching.lifecycle_groups(t.legs).select(
        "merchant_id", "order_id", "expected_c", "base_legs", "adjustment_legs", "base_id", "settlement_date")


@query
def lifecycle_candidates(t):
    return matching.lifecycle_candidates(t.legs, t.lines)


@query
def split_candidates(t):
    return matching.split_candidates(t.legs, t.lines)


@query
def fx_evidence(t):
    foreign = t.legs.filter(X.is_fx("currency"))
    return matching.candidate_edges(foreign, t.lines)


@query
def blocking_efficiency(t):
    return summary.blocking_stats(t.legs, t.lines)


@query
def edge_audit(t):
    return evidence.edge_audit(t.edges).select(
        "settlement_id", "bank_txn_id", "selected_by_settlement", "selected_by_bank", "candidate_disposition", "rejection_reason")


# ---- matching ------------------------------------------------------------

@query
def greedy_assignment(t):
    return greedy_match(matching.candidate_edges(t.legs, t.lines), "settlement_id", "bank_txn_id", "cost_c")


@query
def greedy_increment(t):
    """The last seven days of legs and lines come later; only what they reach is matched again."""
    edges = durable(matching.candidate_edges(t.legs, t.lines))
    since = t.legs.agg(F.date_sub(F.max("settlement_date"), 6).alias("since")).first()["since"]
    late_legs = t.legs.filter(F.col("settlement_date") >= F.lit(since)).select("settlement_id")
    late_lines = t.lines.filter(F.col("value_date") >= F.lit(since)).select("bank_txn_id")
    early = edges.join(late_legs, "settlement_id", "left_anti").join(late_lines, "bank_txn_id", "left_anti")
    names = ("settlement_id", "bank_txn_id", "cost_c")
    changed = late_legs.select(F.concat(F.lit("L"), "settlement_id").alias("node")).unionByName(
        late_lines.select(F.concat(F.lit("R"), "bank_txn_id").alias("node")))
    links = rematch(unit_candidates(edges, *names), durable(links_of_cells(unit_candidates(early, *names))), changed)
    return links.select(F.col("left").alias("settlement_id"), F.col("right").alias("bank_txn_id"), F.col("cost").alias("cost_c"))


@query
def mutual_best_match(t):
    return evidence.mutual_best(t.legs, t.lines).select(
        "settlement_id", "bank_txn_id", "match_type", "confidence_bp", "decision", "cost_c", "has_id")


def _stage(t, number):
    return t.stages.upto(number)[-1].select(
        "settlement_id", _joined("bank_ids").alias("bank_ids"), "confidence_pct", "amount_diff_c")


@query
def exact_id_match(t):
    return _stage(t, 1)


@query
def fuzzy_match(t):
    return _stage(t, 2)


@query
def split_match(t):
    return _stage(t, 3)


@query
def lifecycle_match(t):
    return _stage(t, 4)


@query
def reconcile_cascade(t):
    """Flagship: the decisions of a full run."""
    return t.run.decisions.select(
        "settlement_id", "order_id", "merchant_id", "match_type", _joined("bank_ids").alias("bank_ids"),
        "confidence_pct", "amount_diff_c", "decision")


@query
def decision_tiers(t):
    return summary.decision_tiers(t.run.decisions)


# ---- registers -----------------------------------------------------------

@query
def exception_reasons(t):
    return exceptions.classify_exceptions(t.run.unresolved, t.lines).select(
        "settlement_id", "order_id", "net_c", "settlement_date", "reason")


@query
def exception_reasons_coarse(t):
    return evidence.coarse_exceptions(t.legs, t.mutual).select("settlement_id", "type", "decision", "reason")


@query
def exception_register(t):
    return exceptions.exception_register(t.leg_exceptions, exceptions.ledger_duplicates(t.ledger, t.legs))


@query
def unexplained_bank(t):
    return t.run.unexplained.select("bank_txn_id", "amount_c", "value_date", "narration")


@query
def ledger_duplicates(t):
    paid = exceptions.ledger_duplicates(t.ledger, t.legs).select("order_id", "net_c", F.col("reason").alias("paid_reason"))
    return exceptions.repeated_orders(t.ledger).join(paid, "order_id", "left").select(
        "merchant_id", "order_id", "records", "reason", "net_c", "paid_reason")


@query
def ledger_first(t):
    return t.ledger_rows.select("order_id", "record_id", "customer", "gross_c", "order_date")


def _feed(t):
    """Legs with replays: some arrive twice, some four times."""
    k = F.regexp_extract("settlement_id", "^SETL([0-9]+)-", 1).cast("bigint")
    copies = F.when(k % 90 == 30, F.when(k % 180 == 30, 4).otherwise(2)).otherwise(1)
    return (t.legs.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
            .withColumn("source_row", F.concat("settlement_id", F.lit("/"), F.col("copy"))))


@query
def replay_dedup(t):
    kept, replays = replay.dedup_events(_feed(t), replay.LEG_EVENT, "settlement_event", "source_row")
    return kept.select("event_hash", "source_row", F.lit("KEPT").alias("outcome")).unionByName(
        replays.select("event_hash", "source_row", F.lit("REPLAY").alias("outcome")))


@query
def idempotent_increment(t):
    """A second run: decided legs stay out unless their content changed."""
    prior = replay.with_fingerprint(
        t.legs.join(t.mutual.select("settlement_id"), "settlement_id", "left_semi"), replay.LEG_EVENT)
    k = F.regexp_extract("settlement_id", "^SETL([0-9]+)-", 1).cast("bigint")
    changed = t.legs.withColumn("net_c", F.when(k % 11 == 0, F.col("net_c") + 100).otherwise(F.col("net_c")))
    again = replay.with_fingerprint(changed, replay.LEG_EVENT)
    return replay.increment(again, prior).select("settlement_id", "net_c")


@query
def run_summary(t):
    register = exceptions.exception_register(t.leg_exceptions, exceptions.ledger_duplicates(t.ledger, t.legs))
    return summary.run_summary(t.legs, t.run.decisions, register, t.run.unexplained)


@query
def run_counters(t):
    return summary.run_counters({
        "legs": t.legs, "lines": t.lines, "candidate_edges": t.edges, "accepted": t.mutual,
        "review_queue": t.queue, "exceptions": evidence.coarse_exceptions(t.legs, t.mutual)})


@query
def match_breakdown(t):
    return summary.match_breakdown(t.run.decisions)


# ---- review --------------------------------------------------------------

@query
def review_queue(t):
    return t.queue.select("settlement_id", "candidate_count", "decision", "queue_reason", "policy_version")


@query
def review_batch(t):
    queue = X.stamp(t.queue, event_date=RUN_DATE)
    return evidence.review_batch(queue, 50).select("settlement_id", "candidate_count")


def _labels(t):
    k = F.regexp_extract("settlement_id", "^SETL([0-9]+)-", 1).cast("bigint")
    return t.truth.filter((k % 9 == 0) & F.col("settlement_id").endswith("-1") & F.col("should_match")).select(
        "settlement_id", F.when(k % 2 == 0, "True").otherwise("no").alias("approved"),
        X.id_set("expected_bank_ids")[0].alias("actual_bank_txn_id"))


@query
def review_labels(t):
    return _labels(t).withColumns({"is_approved": X.as_bool("approved"), "event_date": F.lit(RUN_DATE).cast("date")})


@query
def candidate_packs(t):
    """Proposals for unresolved legs: the true line, another leg's line, or too low a confidence."""
    k = F.regexp_extract("settlement_id", "^SETL([0-9]+)-", 1)
    suffix = F.when(k.cast("bigint") % 3 == 0, "-9").when(k.cast("bigint") % 3 == 1, "-11").otherwise("-1")
    proposals = t.run.unresolved.select(
        "settlement_id", F.concat(F.lit("BANK"), k, suffix).alias("bank_txn_id"), (k.cast("bigint") % 60 + 40).alias("confidence_pct"))
    sizes = review.pack_sizes(t.run.unresolved, t.run.unexplained)
    admitted = review.admit_candidates(proposals, t.run.unresolved, t.run.unexplained)
    return sizes.join(admitted, "settlement_id", "left").select(
        "settlement_id", "pack_size", "bank_txn_id", "confidence_pct", "match_type")


def _replies(queue):
    k = F.regexp_extract("settlement_id", "^SETL([0-9]+)-", 1).cast("bigint")
    first = F.col("top_candidates")[0]["bank_txn_id"]
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit('{"recommended_bank_txn_id": "'), first, F.lit('", "reason": "closest"}')))
        .when(k % 4 == 1, '{"recommended_bank_txn_id": null, "reason": "no evidence"}')
        .when(k % 4 == 2, '{"recommended_bank_txn_id": "BANK-X", "reason": "guess"}')
        .when(k % 8 == 3, '["BANK1"]').otherwise('{"recommended_bank_txn_id": '))
    return queue.select("settlement_id", raw.alias("raw"))


@query
def recommendation_gate(t):
    return review.gate_recommendations(_replies(t.queue), t.queue).select(
        "settlement_id", "recommended_bank_txn_id", "reason", "decision")


@query
def ranker_training_set(t):
    return ranker.training_set(t.edges, _labels(t)).select(
        "settlement_id", "bank_txn_id", "amount_diff_c", "day_diff", "has_id", F.col("label").cast("bigint").alias("label"))


@query
def ranker_class_balance(t):
    balance = ranker.class_balance(ranker.training_set(t.edges, _labels(t)))
    return balance.select(F.col("label").cast("bigint").alias("label"), "examples")


@query
def ranker_scores(t):
    model = ranker.fit_ranker(ranker.training_set(t.edges, _labels(t)))
    return ranker.score_queue(model, t.queue).select(
        "settlement_id", "bank_txn_id", F.round("score", 6).alias("score"), "model_rank")


# ---- evaluation ----------------------------------------------------------

def _scored(t):
    return evaluation.outcomes(t.truth, t.run.decisions)


@query
def evaluation_outcomes(t):
    return _scored(t).select("settlement_id", "expected_outcome", "result")


@query
def precision_recall(t):
    return evaluation.precision_recall(_scored(t))


@query
def auto_accept_precision(t):
    return evaluation.auto_accept_precision(t.run.decisions, t.truth)


@query
def case_types(t):
    return evaluation.case_types(t.truth, t.legs, t.lines)


@query
def evaluation_by_case(t):
    return evaluation.by_case(_scored(t), evaluation.case_types(t.truth, t.legs, t.lines))


# ---- story ---------------------------------------------------------------

@query
def leg_status(t):
    return story.leg_status(t.legs, t.run.decisions, t.leg_exceptions).select(
        "settlement_id", "status", "tier", "match_type", "confidence_pct")


@query
def story_timeline(t):
    return story.timeline(t.ledger_rows, t.status).select(
        "order_id", "event_date", "settlement_id", "step", "kind", "text")


@query
def story_verdicts(t):
    return story.verdicts(t.ledger_rows, t.status).select(
        "order_id", "legs", "resolved", "duplicates", "net_c", "status", "confidence", "severity")


@query
def open_stories(t):
    """Stories of one status, worst first."""
    return story.by_severity(story.stories_with(t.verdicts, "UNRESOLVED")).select("order_id", "status", "severity")


@query
def edge_preview(t):
    """The first candidate edges by cost; the limit is the feature."""
    return evidence.preview(matching.candidate_edges(t.legs, t.lines), ["cost_c", "settlement_id", "bank_txn_id"], 100)


@query
def story_narrative(t):
    return story.narratives(t.verdicts, t.status).select("order_id", "part", "settlement_id", "text")


@query
def story_portfolio(t):
    return story.portfolio(t.verdicts)
