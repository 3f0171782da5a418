"""Candidate ranker learned from approved reviewer labels: logistic regression in columns.

The features of a candidate are its amount and day gaps and whether its
narration names the order. Candidates lie within the tolerances, so equal ones
are few kinds, however many rows there are; training counts each kind's
examples and confirmed ones once, and every Newton step is a sum over kinds.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions.scalars import as_bool
from ledgerloom.runtime import durable

FEATURES = ["amount_difference", "date_difference", "has_id_evidence"]
#: Weight of the squared coefficients (not the intercept): keeps them finite where labels are told apart exactly.
RIDGE = 1.0
#: A Newton step below this ends the training.
SETTLED = 1e-9


@dataclass(frozen=True)
class Ranker:
    """Coefficients of one model."""

    intercept: float
    amount_difference: float
    date_difference: float
    has_id_evidence: float
    steps: int = 0

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for name in FEATURES:
            total = total + F.lit(getattr(self, name)) * F.col(name)
        return total

    def score(self) -> Column:
        """Probability that a candidate is the confirmed one."""
        return 1 / (1 + F.exp(-self.margin()))


def approved(labels: DataFrame) -> DataFrame:
    return labels.filter(as_bool("approved"))


def with_features(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "amount_difference": F.col("amount_diff_c") / 100.0,
        "date_difference": F.col("day_diff").cast("double"),
        "has_id_evidence": F.col("has_id").cast("double")})


def training_set(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges of labelled legs; label 1 on the line the reviewer confirmed."""
    truth = approved(labels).select("settlement_id", "actual_bank_txn_id")
    return with_features(edges.join(truth, "settlement_id")).withColumn(
        "label", (F.col("bank_txn_id") == F.col("actual_bank_txn_id")).cast("double"))


def class_balance(training: DataFrame) -> DataFrame:
    return training.groupBy("label").agg(F.count(F.lit(1)).alias("examples"))


def require_two_classes(training: DataFrame) -> None:
    if training.agg(F.count_distinct("label").alias("n")).first()["n"] < 2:
        raise ValueError("training needs both confirmed and rejected candidates")


def fit_ranker(training: DataFrame, max_iter: int = 50) -> Ranker:
    """Newton's method on the ridge likelihood, at most ``max_iter`` steps.

    A step is one aggregation that returns 14 sums; only these reach the
    driver. Rows without a label count as rejected.
    """
    kinds = durable(training.groupBy(*FEATURES).agg(
        F.count(F.lit(1)).cast("double").alias("examples"), F.sum(F.coalesce("label", F.lit(0.0))).alias("confirmed")))
    both = kinds.agg(F.sum("confirmed").alias("yes"), F.sum("examples").alias("all")).first()
    if not both["all"] or both["yes"] in (0.0, both["all"]):
        raise ValueError("training needs both confirmed and rejected candidates")
    inputs = [F.lit(1.0), *map(F.col, FEATURES)]
    size, weights = len(inputs), np.zeros(len(inputs))
    penalty = np.diag([0.0] + [RIDGE] * len(FEATURES))
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    for step in range(max_iter):
        chance = Ranker(*weights.tolist()).score()
        missing = F.col("confirmed") - F.col("examples") * chance
        spread = F.col("examples") * chance * (1 - chance)
        sums = kinds.agg(
            *[F.sum(missing * inputs[i]) for i in range(size)], *[F.sum(spread * inputs[i] * inputs[j]) for i, j in upper]).first()
        slope, bend = np.array(sums[:size]), np.zeros((size, size))
        for (i, j), value in zip(upper, sums[size:]):
            bend[i, j] = bend[j, i] = value
        move = np.linalg.solve(bend + penalty, slope - penalty @ weights)
        weights = weights + move
        if np.abs(move).max() < SETTLED:
            break
    return Ranker(*weights.tolist(), steps=step + 1)


def save_model(model: Ranker, path: str) -> None:
    """One row of coefficients; an earlier model at ``path`` is replaced."""
    SparkSession.active().createDataFrame([asdict(model)]).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(path: str) -> Ranker:
    return Ranker(**SparkSession.active().read.parquet(path).first().asDict())


def score_queue(model: Ranker, queue: DataFrame) -> DataFrame:
    """Candidates of queue items, ranked by the model; items hold few candidates."""
    rows = queue.select("settlement_id", F.explode("top_candidates").alias("c")).select("settlement_id", "c.*")
    scored = with_features(rows).withColumn("score", model.score())
    rank = F.row_number().over(Window.partitionBy("settlement_id").orderBy(F.desc("score"), "bank_txn_id"))
    return scored.select("settlement_id", "bank_txn_id", "score", rank.alias("model_rank"))
