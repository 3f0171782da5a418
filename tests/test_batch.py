"""CSV files in, all result files out, visible together."""

import json

import pytest

from ledgerloom.plans import batch
from ledgerloom.sources import writers as W

NAMES = {"ledger": "ledger.csv", "legs": "legs.csv", "lines": "bank.csv", "truth": "truth.csv"}


@pytest.fixture
def folder(tmp_path):
    """A labelled sample of our own: exact, fuzzy, split, lifecycle, exception, reject and duplicate."""
    where = tmp_path / "in"
    where.mkdir()
    (where / "ledger.csv").write_text("order_id,customer,gross_amount,order_date,status\n" + "".join(
        f"ORD{i},c,100.00,2024-03-01,paid\n" for i in (1, 2, 3, 5, 6, 9)) + "ORD1,c,100.00,2024-03-01,paid\n")
    (where / "legs.csv").write_text(
        "settlement_id,order_id,gross_amount,fee,tax,net_amount,settlement_date,type\n"
        "S1,ORD1,100,0,0,100.00,2024-03-02,settlement\nS2,ORD2,200,0,0,200.00,2024-03-02,settlement\n"
        "S3,ORD3,500,0,0,500.00,2024-03-03,settlement\nS4,ORD3,-50,0,0,-50.00,2024-03-03,settlement_adjustment\n"
        "S5,ORD5,300,0,0,300.00,2024-03-04,settlement\nS6,ORD6,-7,0,0,-7.00,2024-03-04,chargeback\n"
        "S9,ORD9,100,0,0,1x,2024-03-04,settlement\n")
    (where / "bank.csv").write_text(
        "bank_txn_id,amount,value_date,narration\nB1,100.00,2024-03-02,NEFT/ORD1\nB2,201.00,2024-03-03,CR\nB3,450.00,2024-03-03,CR\n"
        "B4,120.00,2024-03-04,CR\nB5,180.00,2024-03-05,CR\nB6,999.00,2024-03-05,CR\nB6,999.00,2024-03-05,CR\n")
    (where / "truth.csv").write_text(
        "settlement_id,true_bank_txn_ids,should_match\nS1,B1,True\nS2,B2,True\nS3,B3,True\nS4,B3,True\nS5,B4;B5,True\nS6,,False\n")
    return where


def read(spark, path, name):
    return spark.read.option("header", True).csv(path[name]).collect() if name in batch.CSV else [
        json.loads(r.value) for r in spark.read.text(path[name]).collect()]


def test_files_of_a_run(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run_id = batch.run_batch(spark, str(folder), out, NAMES)
    path = batch.results(spark, out)
    assert path == batch.results(spark, out, run_id)
    assert {r.settlement_id for r in read(spark, path, "auto_accepted")} == {"S1", "S2", "S3", "S4"}
    assert [(r.settlement_id, r.bank_ids) for r in read(spark, path, "needs_review")] == [("S5", "B4+B5")]
    assert {(r.entity_type, r.settlement_id or "", r.order_id) for r in read(spark, path, "exceptions")} == {
        ("settlement", "S6", "ORD6"), ("ledger_record", "", "ORD1")}
    assert [(r.row_id, r.raw) for r in read(spark, path, "rejected_rows")] == [("S9", "1x")]
    assert [(r.source, r.row_id) for r in read(spark, path, "duplicate_ids")] == [("bank", "B6")]
    assert [r.bank_txn_id for r in read(spark, path, "unexplained")] == ["B6"]
    (total,) = read(spark, path, "summary")
    assert (total["total_settlements"], total["matched_count"], total["auto_accepted_count"], total["exception_count"]) == (6, 5, 4, 2)
    assert total["matches_by_type"] == {"exact_id": 1, "fx_conversion": 0, "fuzzy_amount_date": 1, "split_bank_entries": 1, "lifecycle_adjustment": 2}
    assert (total["true_positives"], total["false_positives"], total["precision"], total["auto_accept_count"]) == (5, 0, 1.0, 4)
    (scores,) = read(spark, path, "evaluation")
    assert scores["recall"] == 1.0 and sum(c["total"] for c in scores["by_case_type"]) == 6
    lines = read(spark, path, "stories")
    place = [(r["order_id"], r["section"]) for r in lines]
    assert place == sorted(place) and {o for o, s in place if s == 0} == {"ORD1", "ORD2", "ORD3", "ORD5", "ORD6", "ORD9"}
    assert [r["kind"] for r in lines if r["order_id"] == "ORD3" and r["section"] == 1] == [
        "order_placed", "captured", "bank_matched", "adjustment", "bank_matched"]


def test_a_run_killed_between_two_files_is_not_seen(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with monkeypatch.context() as patch:
        patch.setattr(W, "export_json", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            batch.run_batch(spark, str(folder), out, NAMES, run_id="half")
    assert batch.results(spark, out) == {} and batch.results(spark, out, "half") == {}
