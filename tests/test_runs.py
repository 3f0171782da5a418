"""Incremental runs, sources, gates and streams."""

import datetime as dt
import json

import pytest

from ledgerloom.config import DEFAULT
from ledgerloom.functions import scalars as X
from ledgerloom.operators import cells, evidence, exceptions, matching, ranker, replay, review, story, summary
from ledgerloom.plans import incremental
from ledgerloom.plans.cascade import reconcile
from ledgerloom.sources import readers as R, schema as S, writers as W
from ledgerloom.streaming import continuous
from pyspark.sql import functions as F
from tests.test_matching import DAY, LEG, LINE, data, frames, links, make_legs, make_lines

LEGS = [("S1", "ORD1", 10000, 1, "settlement"), ("S2", "ORD2", 20000, 1, "settlement"),
        ("S3", "ORD3", 50000, 2, "settlement"), ("S4", "ORD3", -5000, 2, "settlement_adjustment"),
        ("S5", "ORD5", 30000, 3, "settlement"), ("S6", "ORD6", -700, 3, "chargeback"), ("S7", "ORD7", 0, 3, "settlement")]
LINES = [("B1", 10000, 1, "NEFT/ORD1"), ("B2", 20100, 2, "CR"), ("B3", 45000, 2, "CR"),
         ("B4", 12000, 3, "CR"), ("B5", 18000, 4, "CR"), ("B6", 99900, 4, "CR")]
LEDGER = "order_id string, merchant_id string, customer string, gross_c bigint, order_date date, status string, record_id string"


def test_a_run_that_dies_between_appends_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    day, tables = "2024-03-10", lambda w: {
        n: sorted(map(str, R.read_table(spark, w, n).collect())) for n in W.TABLES if R.table_exists(spark, w, n)}
    clean, broken = str(tmp_path / "clean"), str(tmp_path / "broken")
    incremental.run(spark, inputs(spark, [*LEGS, LEGS[0]]), clean, day)
    with monkeypatch.context() as patch:
        done = []

        def append(df, warehouse, table, plain=W.append):
            if len(done) == 3:
                raise OSError("executors gone")
            done.append(table)
            plain(df, warehouse, table)

        patch.setattr(W, "append", append)
        with pytest.raises(OSError):
            incremental.run(spark, inputs(spark, [*LEGS, LEGS[0]]), broken, day)
    assert not R.table_exists(spark, broken, "reconciliation_decisions")
    incremental.run(spark, inputs(spark, [*LEGS, LEGS[0]]), broken, day)
    found = tables(clean)
    assert tables(broken) == found and {"reconciliation_decisions", "reconciliation_exceptions", "candidate_edges"} <= set(found)


def test_stage_tables_need_a_shared_folder_on_a_cluster():
    from ledgerloom.runtime import scratch_root

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError):
        scratch_root(Session)


def ledger(spark):
    rows = [(f"ORD{i}", "m", "c", 10000, DAY, "paid", None) for i in (1, 2, 3, 5, 6, 7)]
    return spark.createDataFrame([*rows, ("ORD1", "m", "c", 10000, DAY, "paid", "L2")], LEDGER)


def inputs(spark, legs=LEGS, lines=LINES):
    left, right = frames(spark, legs, lines)
    return {"ledger": ledger(spark), "legs": left, "lines": right}


def test_cascade_is_whole_and_uses_lines_once(spark):
    pair = frames(spark, *data(21, 60, 60, list(range(10000, 14000, 130)), 6, orders=30))
    run = reconcile(*pair)
    decided = run.decisions.count()
    assert decided + run.unresolved.count() == pair[0].count()
    used = [b for d in run.decisions.filter("match_type <> 'lifecycle_adjustment'").collect() for b in d.bank_ids]
    assert len(used) == len(set(used))


def test_empty_inputs(spark):
    legs, lines = frames(spark, LEGS, LINES)
    none = reconcile(legs.limit(0), lines)
    assert none.decisions.count() == 0 and none.unexplained.count() == len(LINES)
    assert reconcile(legs, lines.limit(0)).unresolved.count() == len(LEGS)


def test_small_cascade_by_hand(spark):
    run = reconcile(*frames(spark, LEGS, LINES))
    got = {(d.settlement_id, d.match_type, "+".join(d.bank_ids)) for d in run.decisions.collect()}
    assert got == {("S1", "exact_id", "B1"), ("S2", "fuzzy_amount_date", "B2"), ("S5", "split_bank_entries", "B4+B5"),
                   ("S3", "lifecycle_adjustment", "B3"), ("S4", "lifecycle_adjustment", "B3")}
    reasons = {r.settlement_id: r.reason for r in exceptions.classify_exceptions(run.unresolved, run.lines).collect()}
    assert set(reasons) == {"S6", "S7"} and reasons["S6"].startswith("Chargeback")
    assert [r.bank_txn_id for r in run.unexplained.collect()] == ["B6"]


def test_hot_group_of_copies_is_matched_in_rank_order(spark):
    n = 3000
    legs = spark.range(n).select(F.format_string("S%05d", "id").alias("settlement_id"))
    legs = legs.select("settlement_id", F.lit("ORD1").alias("order_id"), F.lit("m").alias("merchant_id"),
                       F.lit("r").alias("payment_rail"), F.lit("INR").alias("currency"), F.lit("settlement").alias("type"),
                       F.lit(100).cast("bigint").alias("net_c"), F.lit(100).cast("bigint").alias("recon_c"),
                       F.lit(False).alias("has_expected"), F.lit(DAY).alias("settlement_date"))
    lines = spark.range(n - 500).select(
        F.format_string("B%05d", "id").alias("bank_txn_id"), F.lit("m").alias("merchant_id"), F.lit("r").alias("payment_rail"),
        F.lit("INR").alias("currency"), F.lit(100).cast("bigint").alias("amount_c"), F.lit(DAY).alias("value_date"),
        F.lit("ORD1").alias("narration"))
    got = links(matching.exact_id_match(legs, lines))
    assert got == {(f"S{i:05d}", f"B{i:05d}") for i in range(n - 500)}


def test_ranged_rank_equals_row_number(spark):
    named = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("cell"),
        F.sha2(F.col("id").cast("string"), 256).alias("id"))
    got = {(r.cell, r.id): r["rank"] for r in cells.ranged_rank(named).collect()}
    by_cell = {}
    for r in named.collect():
        by_cell.setdefault(r.cell, []).append(r.id)
    assert got == {(c, i): n for c, ids in by_cell.items() for n, i in enumerate(sorted(ids), 1)}


def test_increment_is_idempotent_and_takes_changes(spark, tmp_path):
    warehouse, labels = str(tmp_path / "w"), tmp_path / "labels.csv"
    labels.write_text("settlement_id,approved,actual_bank_txn_id\nS1,true,B1\n")
    dry = incremental.run(spark, inputs(spark), warehouse, "2024-03-10", write=False)
    assert not R.table_exists(spark, warehouse, "reconciliation_decisions")
    first = incremental.run(spark, inputs(spark, [*LEGS, LEGS[0], LEGS[0]]), warehouse, "2024-03-10", labels_path=str(labels))
    counts = {r.table_name: r.row_count for r in incremental.counters(first).collect()}
    assert counts["ingestion_deduplication"] == 2 and counts["reconciliation_decisions"] == 5
    assert counts["ledger_exceptions"] == 1 and counts["review_labels"] == 1
    assert dry["reconciliation_decisions"].count() == 5
    again = incremental.run(spark, inputs(spark), warehouse, "2024-03-11")
    assert again["reconciliation_decisions"].count() == 0 and again["reconciliation_exceptions"].count() == 0
    # A changed open leg comes back; a used line is not given twice.
    changed = [("S6", "ORD6", -800, 3, "chargeback"), ("S9", "ORD1", 10000, 1, "settlement")]
    third = incremental.run(spark, inputs(spark, [*LEGS, *changed], [*LINES, ("B9", -800, 3, "ORD6")]), warehouse, "2024-03-12")
    got = [(r.settlement_id, *r.bank_ids) for r in third["reconciliation_decisions"].collect()]
    assert got == [("S6", "B9")]
    stored = R.read_table(spark, warehouse, "reconciliation_decisions")
    assert stored.count() == 6 and set(W.TABLES["reconciliation_decisions"]) <= set(stored.columns)


def test_replay_without_row_key(spark):
    legs, _ = frames(spark, [LEGS[0]] * 3 + LEGS[1:3], LINES)
    kept, audit = replay.dedup_events(legs, replay.LEG_EVENT, "settlement_event")
    assert kept.count() == 3 and sorted(r.copy for r in audit.collect()) == ["2", "3"]


def test_csv_source_defaults_and_bad_values(spark, tmp_path):
    path = tmp_path / "legs.csv"
    path.write_text("net_amount,settlement_id,order_id,settlement_date,type,currency,expected_bank_amount\n"
                    "10.005,S1,A_1,2024-01-31,settlement,,\n"
                    "oops,S2,A2,2024-02-30,refund,USD,12.5\n")
    rows = {r.settlement_id: r for r in R.conform_settlements(R.read_source(spark, str(path), S.SETTLEMENT)).collect()}
    one, two = rows["S1"], rows["S2"]
    assert (one.net_c, one.currency, one.merchant_id, one.has_expected, one.settlement_date) == (
        1001, "INR", "default", False, dt.date(2024, 1, 31))
    assert (two.net_c, two.recon_c, two.has_expected, two.settlement_date) == (None, 1250, True, None)


def test_settlement_json(spark, tmp_path):
    path = tmp_path / "p.json"
    items = [{"type": "payment", "entity_id": "e1", "order_receipt": "O1", "amount": 1000, "credit": 976, "fee": 20, "tax": 4,
              "settled_at": 1709251200, "currency": "INR"},
             {"type": "refund", "id": "e2", "debit": 500, "created_at": 1709337600}, {"type": "other", "id": "e3", "created_at": 0}]
    path.write_text(json.dumps({"items": items}))
    rows = R.read_settlement_json(spark, str(path)).collect()
    assert [(r.settlement_id, r.order_id, r.net_amount, r.settlement_date, r.type) for r in rows] == [
        ("e1", "O1", "9.76", "2024-03-01", "settlement"), ("e2", "UNKNOWN_ORDER", "-5.00", "2024-03-02", "refund"),
        ("e3", "UNKNOWN_ORDER", "0.00", "1970-01-01", "other")]


def test_sinks(spark, tmp_path):
    run = reconcile(*frames(spark, LEGS, LINES))
    W.export_csv(run.decisions.filter("1 = 0"), str(tmp_path / "empty"))
    assert "settlement_id" in spark.read.option("header", True).csv(str(tmp_path / "empty")).columns
    W.export_csv(run.decisions, str(tmp_path / "d"))
    back = spark.read.option("header", True).csv(str(tmp_path / "d"))
    assert back.filter("bank_ids = 'B4+B5'").count() == 1 and back.filter("amount_diff = '1.00'").count() == 1
    W.export_json(summary.match_breakdown(run.decisions), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_gate_fails_closed(spark):
    queue = spark.createDataFrame(
        [(f"S{i}", [("B1",), ("B2",)]) for i in range(6)], "settlement_id string, top_candidates array<struct<bank_txn_id string>>")
    raw = ['{"recommended_bank_txn_id": "B2", "reason": "%s"}' % ("x" * 1200), '{"recommended_bank_txn_id": null}',
           '{"recommended_bank_txn_id": "B9", "reason": "r"}', "not json", '[{"recommended_bank_txn_id": "B1"}]', None]
    replies = spark.createDataFrame([(f"S{i}", r) for i, r in enumerate(raw)], "settlement_id string, raw string")
    got = {r.settlement_id: (r.recommended_bank_txn_id, r.reason) for r in review.gate_recommendations(replies, queue).collect()}
    assert got["S0"] == ("B2", "x" * 1000) and got["S1"] == (None, "No explanation supplied.")
    assert got["S2"][0] is None and "outside the supplied" in got["S2"][1]
    assert all(got[s][0] is None and "not valid JSON" in got[s][1] for s in ("S3", "S4", "S5"))


def test_ranker_needs_two_classes(spark, tmp_path):
    pair = frames(spark, *data(22, 40, 40, [10000, 10200, 10500], 5, orders=40))
    edges = evidence.evidence_edges(*pair)
    labels = edges.groupBy("settlement_id").agg(F.min("bank_txn_id").alias("actual_bank_txn_id")).withColumn("approved", F.lit("yes"))
    training = ranker.training_set(edges, labels)
    with pytest.raises(ValueError):
        ranker.require_two_classes(training.filter("label = 1"))
    model = ranker.fit_ranker(training)
    ranker.save_model(model, str(tmp_path / "m"))
    scored = ranker.score_queue(ranker.load_model(str(tmp_path / "m")), evidence.candidate_sets(edges))
    assert scored.filter("model_rank = 1").count() == edges.select("settlement_id").distinct().count()


def test_story_of_every_leg(spark):
    legs, lines = frames(spark, LEGS, LINES)
    run = reconcile(legs, lines)
    raised = exceptions.classify_exceptions(run.unresolved, lines)
    status = story.leg_status(legs, run.decisions, raised)
    rows = exceptions.ledger_first(ledger(spark))
    verdict = {r.order_id: (r.status, float(r.confidence)) for r in story.verdicts(rows, status).collect()}
    assert verdict == {"ORD1": ("RECONCILED", 0.99), "ORD2": ("RECONCILED", 0.9), "ORD3": ("RECONCILED", 0.98),
                       "ORD5": ("RECONCILED", 0.8), "ORD6": ("UNRESOLVED", 0.0), "ORD7": ("UNRESOLVED", 0.0)}
    kinds = [r.kind for r in story.timeline(rows, status).filter("order_id = 'ORD3'").orderBy(
        "event_date", "leg_date", "settlement_id", "step").collect()]
    assert kinds == ["order_placed", "captured", "bank_matched", "adjustment", "bank_matched"]


def test_edge_stream_equals_batch(spark, tmp_path):
    legs, lines = frames(spark, *data(23, 30, 30, [10000, 10200, 11500], 6))
    legs.write.parquet(str(tmp_path / "s"))
    lines.write.parquet(str(tmp_path / "b"))
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    edges = continuous.stream_edges(read("s", legs.schema), read("b", lines.schema), delay="30 days")
    query = edges.writeStream.format("memory").queryName("edge_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in matching.candidate_edges(legs, lines).collect()}
    assert {tuple(r) for r in spark.table("edge_stream").collect()} == want


def test_stream_replay_guard(spark, tmp_path):
    legs, _ = frames(spark, [LEGS[0]] * 3 + LEGS, LINES)
    legs.withColumn("seen_at", F.lit("2024-03-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "s"))
    feed = spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).parquet(str(tmp_path / "s"))
    seen = []
    unique = continuous.stream_dedup(feed, replay.LEG_EVENT, "seen_at", "1 day")
    continuous.increments(unique, lambda df, _: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == len(LEGS)


@pytest.mark.parametrize("text,want", [("2.345", 235), (" 7 ", 700), ("", None), ("x", None), ("-0.5", -50)])
def test_money(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(X.to_cents(X.money("v")).alias("c")).first().c == want


def test_confidence_and_gate_agree(spark):
    rows = spark.range(0, 1500).select("id", X.confidence_pct("id").alias("p")).collect()
    assert all(r.p == round(100 * round(max(0.55, 1 - (r.id / 100) / 30), 2)) for r in rows if r.id % 30 == 15)
    assert max(r.id for r in rows if r.p >= 85) == DEFAULT.fuzzy_cost_cut
