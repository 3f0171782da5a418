"""Replay of a labelled sample with published results.

The sample folder is searched for CSV files by their header; without it the
test is skipped.
"""

import csv
import glob
import os

import pytest

from ledgerloom.operators.evaluation import auto_accept_precision, by_case, outcomes, precision_recall
from ledgerloom.operators.exceptions import classify_exceptions, exception_register, ledger_duplicates
from ledgerloom.plans.cascade import reconcile
from ledgerloom.runtime import durable
from ledgerloom.sources import readers as R, schema as S

ROOT = os.environ.get("RECON_SAMPLE_DIR", "")


def _find(*columns, without=()):
    for path in sorted(glob.glob(f"{ROOT}/*/*.csv") if ROOT else []):
        with open(path, newline="", encoding="utf-8") as handle:
            header = next(csv.reader(handle), [])
        if set(columns) <= set(header) and not set(without) & set(header):
            yield path


def _rows(path):
    with open(path, newline="", encoding="utf-8") as handle:
        return list(csv.DictReader(handle))


@pytest.fixture(scope="module")
def sample(spark):
    found = {
        "ledger": next(_find("customer", "order_date"), None),
        "legs": next(_find("net_amount", "fee", "settlement_date"), None),
        "bank": next(_find("narration", "value_date"), None),
        "truth": next(_find("settlement_id", "case_type"), None),
    }
    if None in found.values():
        pytest.skip("no sample folder")
    legs = durable(R.conform_settlements(R.read_source(spark, found["legs"], S.SETTLEMENT)))
    lines = durable(R.conform_bank(R.read_source(spark, found["bank"], S.BANK)))
    ledger = R.conform_ledger(R.read_source(spark, found["ledger"], S.LEDGER))
    truth = R.conform_truth(R.read_source(spark, found["truth"], S.TRUTH))
    return ledger, legs, lines, truth, reconcile(legs, lines)


def test_links_equal_published(sample):
    decisions = sample[4].decisions.collect()
    ours = {(d.settlement_id, d.order_id, d.match_type, "+".join(d.bank_ids), d.confidence_pct / 100) for d in decisions}
    theirs = {
        (r["settlement_id"], r["order_id"], r["match_type"], r["matched_bank_txn_ids"], float(r["confidence"]))
        for path in _find("matched_bank_txn_ids", "confidence") for r in _rows(path)}
    assert len(theirs) == 90
    assert ours == theirs
    tiers = [d.decision for d in decisions]
    assert (tiers.count("AUTO_ACCEPTED"), tiers.count("NEEDS_REVIEW")) == (87, 3)


def test_exceptions_equal_published(sample):
    ledger, legs, lines, _, run = sample
    register = exception_register(classify_exceptions(run.unresolved, lines), ledger_duplicates(ledger, legs))
    ours = {(r.entity_type, r.settlement_id, r.order_id, r.net_c, str(r.settlement_date), r.reason) for r in register.collect()}
    theirs = {
        (r["entity_type"], r["settlement_id"], r["order_id"], round(float(r["net_amount"]) * 100), r["settlement_date"], r["reason"])
        for r in _rows(next(_find("entity_type", "reason")))}
    assert ours == theirs and len(ours) == 12


def test_unexplained_lines(sample):
    assert sample[4].unexplained.count() == 7


def test_scores(sample):
    _, _, _, truth, run = sample
    scored = outcomes(truth, run.decisions)
    row = precision_recall(scored).first()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.true_negatives) == (90, 0, 2, 9)
    assert (float(row.precision), float(row.recall), float(row.match_rate_pct)) == (1.0, 0.978, 89.1)
    auto = auto_accept_precision(run.decisions, truth).first()
    assert (auto.auto_accept_count, float(auto.auto_accept_precision)) == (87, 1.0)
    cases = by_case(scored.drop("case_type"), truth).collect()
    assert sum(c.total for c in cases) == 101
