"""Runs become visible whole, keys are found by day and range, exceptions close."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ranker
from ledgerloom.plans import incremental
from ledgerloom.sources import readers as R, runs, writers as W
from tests.test_matching import frames
from tests.test_runs import LEGS, LINES, inputs, ledger


def test_an_exception_closes_when_its_leg_is_matched(spark, tmp_path):
    w = str(tmp_path / "w")
    incremental.run(spark, inputs(spark, [*LEGS, ("S8", "ORD8", 8800, 5, "settlement")]), w, "2024-03-10")
    opened = {r.settlement_id for r in incremental.open_exceptions(spark, w).collect()}
    assert opened == {"S6", "S7", "S8"}
    late = [*LINES, ("B8", 8800, 5, "ORD8"), ("B9", -800, 3, "ORD6")]
    again = [*LEGS, ("S8", "ORD8", 8800, 5, "settlement"), ("S6", "ORD6", -800, 3, "chargeback")]
    out = incremental.run(spark, inputs(spark, again, late), w, "2024-03-11")
    assert {(r.settlement_id, r.state) for r in out["reconciliation_exceptions"].collect()} == {("S8", "RESOLVED"), ("S6", "SUPERSEDED")}
    assert {r.settlement_id for r in incremental.open_exceptions(spark, w).collect()} == {"S7"}
    third = incremental.run(spark, inputs(spark, again, late), w, "2024-03-12")
    assert third["reconciliation_exceptions"].count() == 0 and third["reconciliation_decisions"].count() == 0
    assert {r.settlement_id for r in incremental.open_exceptions(spark, w).collect()} == {"S7"}


def test_a_run_is_invisible_until_its_commit(spark, tmp_path, monkeypatch):
    w = str(tmp_path / "w")
    with monkeypatch.context() as patch:
        patch.setattr(runs, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone before the last write")))
        with pytest.raises(OSError):
            incremental.run(spark, inputs(spark), w, "2024-03-10")
    assert R.table_exists(spark, w, "reconciliation_decisions") and runs.commits(spark, w) == []
    assert all(R.read_table(spark, w, n).count() == 0 for n in W.TABLES if R.table_exists(spark, w, n))
    incremental.run(spark, inputs(spark), w, "2024-03-10")
    assert R.read_table(spark, w, "reconciliation_decisions").count() == 5 and len(runs.commits(spark, w)) == 1


def _month(month, n=4):
    """Legs and lines of a later period with IDs of their own; days count from March."""
    legs = [(f"S{month:02d}{i}", f"ORD{month:02d}{i}", 10_000 + 700 * i, 40 * month + i, "settlement") for i in range(n)]
    return legs, [(f"B{month:02d}{i}", a, d, o) for i, (_, o, a, d, _) in enumerate(legs)]


def test_files_read_do_not_grow_with_the_history(spark, tmp_path, monkeypatch):
    w, opened = str(tmp_path / "w"), []
    plain = runs.rows_of

    def watched(spark_, root, table, ids):
        df = plain(spark_, root, table, ids)
        opened[-1] += len(df.inputFiles()) if df is not None else 0
        return df

    monkeypatch.setattr(runs, "rows_of", watched)
    for month in range(3):
        opened.append(0)
        legs, lines = _month(month)
        out = incremental.run(spark, inputs(spark, legs, lines), w, f"2024-0{month + 4}-01")
        assert out["reconciliation_decisions"].count() == 4
    assert opened == [0, 0, 0]
    # rows of an old month are still known, whatever came since; a line that moved to another day too
    opened.append(0)
    legs, lines = _month(1)
    moved = [(i, a, d + 2, o) for i, a, d, o in lines]
    new = [(f"{s}X", o, a, d, t) for s, o, a, d, t in legs]
    out = incremental.run(spark, inputs(spark, legs + new, moved), w, "2024-08-01")
    assert out["reconciliation_decisions"].count() == 0 and opened[-1] > 0


def test_rejects_duplicates_replies_and_scores_are_tables_of_the_run(spark, tmp_path):
    w, folder = str(tmp_path / "w"), tmp_path / "in"
    folder.mkdir()
    (folder / "ledger.csv").write_text("order_id,customer,gross_amount,order_date,status\nORD1,c,100.00,2024-03-01,paid\nORD2,c,x,2024-03-01,paid\n")
    (folder / "legs.csv").write_text(
        "settlement_id,order_id,gross_amount,fee,tax,net_amount,settlement_date,type\n"
        "S1,ORD1,100,0,0,100.00,2024-03-02,settlement\nS2,ORD2,100,0,0,abc,2024-03-02,settlement\n"
        "S3,ORD3,70,0,0,70.00,2024-03-02,settlement\n")
    (folder / "bank.csv").write_text(
        "bank_txn_id,amount,value_date,narration\nB1,100.00,2024-03-02,NEFT/ORD1\nB1,100.00,2024-03-03,NEFT/ORD1\n"
        "B2,76.00,2024-03-02,CR\nB3,64.50,2024-03-02,CR\nB4,bad,2024-03-02,CR\n")
    names = {"ledger": "ledger.csv", "legs": "legs.csv", "lines": "bank.csv"}
    replies = spark.createDataFrame([("S3", '{"recommended_bank_txn_id": "B2", "reason": "near"}')], "settlement_id string, raw string")
    model = ranker.Ranker(0.0, -1.0, -0.5, 3.0)
    source = incremental.read_inputs(spark, str(folder), names)
    incremental.run(spark, source, w, "2024-03-10", replies=replies, model=model)
    read = lambda name: R.read_table(spark, w, name)
    assert sorted((r.source, r.row_id, r.raw) for r in read("rejected_rows").collect()) == [
        ("bank", "B4", "bad"), ("order_ledger", "ORD2", "x"), ("settlements", "S2", "abc")]
    assert [(r.row_id, r.copies) for r in read("duplicate_ids").collect()] == [("B1", 2)]
    assert not R.table_exists(spark, w, "reconciliation_exceptions")  # S1 and S3 are linked, S2 is a reject and no exception
    decided = {(r.settlement_id, *r.bank_ids) for r in read("reconciliation_decisions").collect()}
    assert ("S1", "B1") in decided
    scores = {(r.settlement_id, r.bank_txn_id, r.model_rank): r.score for r in read("candidate_scores").collect()}
    assert set(scores) == {("S3", "B3", 1), ("S3", "B2", 2)} and all(0 < s < 1 for s in scores.values())
    assert [(r.settlement_id, r.recommended_bank_txn_id) for r in read("ai_recommendations").collect()] == [("S3", "B2")]
    again = incremental.run(spark, source, w, "2024-03-11")
    assert again["rejected_rows"].count() == again["duplicate_ids"].count() == 0
