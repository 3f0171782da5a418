"""Sinks: partitioned warehouse tables and flat exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.scalars import from_cents

# Tables of the warehouse and their partition columns.
TABLES = {
    "candidate_edges": ("event_date",),
    "ingestion_deduplication": ("entity_type", "event_date"),
    "reconciliation_decisions": ("event_date",),
    "reconciliation_exceptions": ("event_date",),
    "ai_review_queue": ("event_date",),
    "ledger_exceptions": ("event_date",),
    "review_labels": ("event_date",),
    "ai_recommendations": ("event_date",),
    "candidate_scores": ("event_date",),
    "rejected_rows": ("event_date",),
    "duplicate_ids": ("event_date",),
    "decided_keys": ("key_day",),
    "used_lines": (),
}


def append(df: DataFrame, warehouse: str, table: str, partitions: Sequence[str] | None = None) -> None:
    """Append to a warehouse table.

    Tables are partitioned by day; inside a day the rows of a merchant are
    brought together, so that its files can be skipped, and AQE rebalancing
    splits hot merchants and joins small ones. Rows with a ``run_id`` are
    visible once that run is committed (see ``runs``).
    """
    columns = list(partitions or TABLES[table])
    if "run_id" in df.columns:
        columns.insert(0, "run_id")
    (df.hint("rebalance", *columns, *(["merchant_id"] if "merchant_id" in df.columns else []))
       .write.mode("append").partitionBy(*columns).parquet(f"{warehouse}/{table}"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; cents become decimals, arrays become joined text."""
    columns = []
    for field in df.schema:
        name, kind = field.name, field.dataType.typeName()
        if name.endswith("_c"):
            columns.append(from_cents(name).alias(name[:-2]))
        elif kind == "array":
            columns.append(F.array_join(name, "+").alias(name))
        else:
            columns.append(F.col(name))
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
