"""Committed runs of a warehouse or a result folder.

Every table a run writes carries its run ID as a partition. The run's last
write is one row in ``run_commits``; readers see the rows of committed runs
only, so a run that dies leaves nothing visible. The row also holds which leg
days and line IDs the run was about, so that a later run opens only the files
of runs that can hold its keys. One run writes to a warehouse at a time.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

COMMITS = "run_commits"
_SCHEMA = "run_id string, seq long, first_day string, last_day string, first_line string, last_line string"


@dataclass(frozen=True)
class Commit:
    run_id: str
    seq: int
    first_day: str | None = None
    last_day: str | None = None
    first_line: str | None = None
    last_line: str | None = None


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All committed runs in order, one row each."""
    path = f"{root}/{COMMITS}"
    if not exists(spark, path):
        return []
    rows = spark.read.schema(_SCHEMA).parquet(path).collect()
    return sorted((Commit(**r.asDict()) for r in rows), key=lambda c: c.seq)


def commit(spark: SparkSession, root: str, record: Commit) -> None:
    """The write that makes a run visible."""
    spark.createDataFrame([asdict(record)], _SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")


def sharing_days(known: list[Commit], first: str | None, last: str | None) -> list[str]:
    """Runs with legs of these days."""
    if first is None:
        return []
    return [c.run_id for c in known if c.first_day is not None and c.first_day <= last and c.last_day >= first]


def sharing_lines(known: list[Commit], first: str | None, last: str | None) -> list[str]:
    """Runs that used lines with IDs in this range."""
    if first is None:
        return []
    return [c.run_id for c in known if c.first_line is not None and c.first_line <= last and c.last_line >= first]


def rows_of(spark: SparkSession, root: str, table: str, run_ids: list[str]) -> DataFrame | None:
    """The rows that these runs wrote; folders of other runs are not even listed."""
    paths = [p for p in (f"{root}/{table}/run_id={r}" for r in run_ids) if exists(spark, p)]
    if not paths:
        return None
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).drop("run_id")
