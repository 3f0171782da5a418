"""Scoring of decisions against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import texts
from ledgerloom.config import DEFAULT, MatchConfig
from ledgerloom.functions.scalars import id_set, pct


def outcomes(truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """One strict result per label; a wrong link is FP_FN."""
    predicted = decisions.select("settlement_id", F.array_sort("bank_ids").alias("predicted_ids"))
    expected = id_set("expected_bank_ids")
    linked = F.coalesce(F.size("predicted_ids") > 0, F.lit(False))
    result = (
        F.when(F.col("should_match") & linked & (F.col("predicted_ids") == expected), "TP")
        .when(F.col("should_match") & linked, "FP_FN").when(F.col("should_match"), "FN")
        .when(linked, "FP").otherwise("TN"))
    return truth.join(predicted, "settlement_id", "left").withColumn("result", result)


def _is(*names: str) -> Column:
    return F.col("result").isin(*names)


def _share(part: Column, whole: Column) -> Column:
    return F.round(part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0)), 3).cast("decimal(5,3)")


def precision_recall(scored: DataFrame) -> DataFrame:
    tp, fp = F.count_if(_is("TP")), F.count_if(_is("FP", "FP_FN"))
    fn, tn = F.count_if(_is("FN", "FP_FN")), F.count_if(_is("TN"))
    return scored.agg(
        F.count(F.lit(1)).alias("total_records"), tp.alias("true_positives"), fp.alias("false_positives"),
        fn.alias("false_negatives"), tn.alias("true_negatives"), F.count_if(_is("FP_FN")).alias("incorrect_forced_matches"),
        _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        pct(F.count_if(F.col("predicted_ids").isNotNull()), F.count(F.lit(1))).alias("match_rate_pct"))


def by_case(scored: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case type; here any wrong link counts as forced."""
    return (
        scored.join(cases.select("settlement_id", "case_type"), "settlement_id").groupBy("case_type").agg(
            F.count(F.lit(1)).alias("total"), F.count_if(_is("TP")).alias("true_positives"),
            F.count_if(_is("FN", "TN")).alias("exceptions"),
            F.count_if(_is("FP", "FP_FN")).alias("incorrect_forced_matches")))


def auto_accept_precision(decisions: DataFrame, truth: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Precision among auto-accepted links; unlabelled links are not judged."""
    auto = decisions.filter(F.col("confidence_pct") >= cfg.auto_accept_pct)
    label = truth.select("settlement_id", "should_match", id_set("expected_bank_ids").alias("expected_ids"))
    right = F.col("should_match") & (F.array_sort("bank_ids") == F.col("expected_ids"))
    judged = F.col("should_match").isNotNull()
    tp, fp = F.count_if(judged & right), F.count_if(judged & ~right)
    return auto.join(label, "settlement_id", "left").agg(
        F.count(F.lit(1)).alias("auto_accept_count"), tp.alias("auto_true_positives"), fp.alias("auto_false_positives"),
        _share(tp, tp + fp).alias("auto_accept_precision"))


def case_types(truth: DataFrame, legs: DataFrame, lines: DataFrame) -> DataFrame:
    """Case type of each label from its leg and true lines."""
    label = truth.select("settlement_id", "should_match", "expected_bank_ids")
    leg = legs.select("settlement_id", "merchant_id", "order_id", "type", "net_c", "settlement_date")
    gaps = (
        label.filter("should_match").select("settlement_id", F.explode(id_set("expected_bank_ids")).alias("bank_txn_id"))
        .join(lines.select("bank_txn_id", "amount_c", "value_date"), "bank_txn_id")
        .join(leg.select("settlement_id", "settlement_date"), "settlement_id")
        .groupBy("settlement_id").agg(
            F.max(F.abs(F.datediff("value_date", "settlement_date"))).alias("day_gap"),
            F.sum("amount_c").alias("paid_c")))
    partials = (
        leg.filter(F.col("type") == "partial_refund").groupBy("merchant_id", "order_id")
        .agg(F.count(F.lit(1)).alias("partials")))
    ambiguous = F.col("order_id").contains("AMBIGUOUS")
    case = (
        F.when(~F.col("should_match"),
               F.when(F.col("type") == "duplicate_settlement", texts.CASE_DUPLICATE)
               .when(ambiguous, texts.CASE_AMBIGUOUS).otherwise(texts.CASE_MISSING))
        .when(F.col("type").isin("refund", "partial_refund"),
              F.when(F.coalesce("partials", F.lit(0)) > 1, texts.CASE_SPLIT_REFUND).otherwise(texts.CASE_PARTIAL_REFUND))
        .when(F.col("type").isin(*texts.ADJUSTMENT_TYPES) | F.col("order_id").contains("ADJUSTMENT"), texts.CASE_LIFECYCLE)
        .when(ambiguous, texts.CASE_AMBIGUOUS)
        .when(F.col("day_gap") > 3, texts.CASE_DELAYED)
        .when(F.col("paid_c") != F.col("net_c"), texts.CASE_DISCREPANCY)
        .otherwise(texts.CASE_NORMAL))
    return (
        label.join(leg, "settlement_id").join(gaps, "settlement_id", "left")
        .join(partials, ["merchant_id", "order_id"], "left")
        .select("settlement_id", case.alias("case_type")))
