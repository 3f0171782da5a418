"""One call from a folder of CSV files to all result files of a run.

Every file of a run lies under the run's ID; the commit record is written
last, and ``results`` gives the files of committed runs only. A run that dies
between two files is not seen, and the next one writes a whole set of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.operators import evaluation, exceptions, story, summary
from ledgerloom.operators.pools import repeated_ids
from ledgerloom.plans.cascade import reconcile
from ledgerloom.plans.incremental import read_inputs
from ledgerloom.runtime import durable, scratch
from ledgerloom.sources import readers as R, runs, schema as S, writers as W

CSV = ("auto_accepted", "needs_review", "exceptions", "unexplained", "rejected_rows", "duplicate_ids")
JSON = ("summary", "evaluation", "stories")
_STORY = ["merchant_id", "order_id", "section", "event_date", "leg_date", "settlement_id", "step"]


def run_batch(
    spark: SparkSession, folder: str, out: str, names: dict[str, str], cfg: MatchConfig = DEFAULT, run_id: str | None = None,
) -> str:
    """Reconciles the files ``names`` (ledger, legs, lines and optionally truth) of ``folder``; returns the run's ID."""
    known = runs.commits(spark, out)
    run_id = run_id or uuid.uuid4().hex
    with scratch():
        for name, table in _results(spark, folder, names, cfg).items():
            write = W.export_csv if name in CSV else W.export_json
            write(table, f"{out}/{run_id}/{name}")
    runs.commit(spark, out, runs.Commit(run_id, known[-1].seq + 1 if known else 1))
    return run_id


def results(spark: SparkSession, out: str, run_id: str | None = None) -> dict[str, str]:
    """Paths of the result files of a committed run, by default of the last one; nothing where there is none."""
    done = [c.run_id for c in runs.commits(spark, out)]
    chosen = run_id or (done[-1] if done else None)
    return {name: f"{out}/{chosen}/{name}" for name in (*CSV, *JSON)} if chosen in done else {}


def _results(spark, folder, names, cfg) -> dict[str, DataFrame]:
    source = {name: durable(df) for name, df in read_inputs(spark, folder, names, cfg).items()}
    bad = source["rejected"].filter("source = 'settlements'").select(F.col("row_id").alias("settlement_id")).distinct()
    legs = durable(source["legs"].join(bad, "settlement_id", "left_anti"))
    repeated = repeated_ids(source["legs"], "settlements", "settlement_id").unionByName(
        repeated_ids(source["lines"], "bank", "bank_txn_id"))
    run = reconcile(legs, source["lines"], cfg)
    of_legs = durable(exceptions.classify_exceptions(run.unresolved, run.lines, cfg))
    register = durable(exceptions.exception_register(of_legs, exceptions.ledger_duplicates(source["ledger"], run.legs)))
    unexplained = durable(run.unexplained)
    out = {
        "auto_accepted": run.decisions.filter(F.col("decision") == texts.AUTO),
        "needs_review": run.decisions.filter(F.col("decision") == texts.REVIEW),
        "exceptions": register, "unexplained": unexplained, "rejected_rows": source["rejected"], "duplicate_ids": repeated}
    totals = _row(
        summary.run_summary(run.legs, run.decisions, register, unexplained), _by_type(run.decisions),
        summary.blocking_stats(run.legs, run.lines, cfg).agg(F.coalesce(F.sum("blocked_pairs"), F.lit(0)).alias("pairs_compared")))
    if "truth" in names:
        truth = durable(R.conform_truth(R.read_source(spark, f"{folder}/{names['truth']}", S.TRUTH), cfg))
        scored = durable(evaluation.outcomes(truth, run.decisions))
        counts = evaluation.precision_recall(scored).select(
            "true_positives", "false_positives", "false_negatives", "true_negatives", "precision", "recall")
        totals = _row(totals, counts, evaluation.auto_accept_precision(run.decisions, truth, cfg))
        out["evaluation"] = _evaluation(scored, truth, run)
    out["summary"] = totals
    status = durable(story.leg_status(run.legs, run.decisions, of_legs))
    out["stories"] = stories(exceptions.ledger_first(source["ledger"]), status, cfg)
    return out


def _row(*parts: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def _by_type(decisions: DataFrame) -> DataFrame:
    """One row: links by match type, as columns of one struct (there are six types)."""
    kinds = (texts.EXACT, texts.FX, texts.FUZZY, texts.SPLIT, texts.LIFECYCLE)
    return decisions.agg(F.struct(*[F.count_if(F.col("match_type") == k).alias(k) for k in kinds]).alias("matches_by_type"))


def _evaluation(scored: DataFrame, truth: DataFrame, run) -> DataFrame:
    """One document: the totals and one entry for each case type, of which there are nine."""
    given = truth.filter("case_type IS NOT NULL").select("settlement_id", "case_type")
    derived = evaluation.case_types(truth, run.legs, run.lines).withColumnRenamed("case_type", "derived")
    cases = derived.join(given, "settlement_id", "full").select(
        "settlement_id", F.coalesce("case_type", "derived").alias("case_type"))
    by_case = evaluation.by_case(scored.drop("case_type"), cases)
    entries = by_case.agg(F.array_sort(F.collect_list(F.struct(*by_case.columns))).alias("by_case_type"))
    return _row(evaluation.precision_recall(scored), entries)


def stories(ledger_rows: DataFrame, status: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """All stories as lines in order: an order's verdict, its events, its summary.

    Lines are dealt by range over order and place, so an order of any number of
    events goes over as many files as it needs, one after the other.
    """
    def line(df, section, **columns):
        absent = {"event_date": "date", "leg_date": "date", "settlement_id": "string", "step": "int", "kind": "string", "text": "string",
                  "status": "string", "confidence": "decimal(5,3)", "net_c": "bigint"}
        have = {n: c.cast(absent[n]) for n, c in columns.items()}
        return df.select("merchant_id", "order_id", F.lit(section).alias("section"),
                         *[have.get(n, F.lit(None).cast(t)).alias(n) for n, t in absent.items()])

    verdict = durable(story.verdicts(ledger_rows, status))
    heads = line(verdict, 0, status=F.col("status"), confidence=F.col("confidence"), net_c=F.col("net_c"))
    events = line(story.timeline(ledger_rows, status, cfg), 1, **{n: F.col(n) for n in ("event_date", "leg_date", "settlement_id", "step", "kind", "text")})
    ends = line(story.narratives(verdict, status), 2, settlement_id=F.col("settlement_id"), step=F.col("part"), text=F.col("text"))
    return heads.unionByName(events).unionByName(ends).repartitionByRange(*_STORY).sortWithinPartitions(*_STORY)
