"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where Spark runs in
    this very process is a folder of our own made: executors elsewhere would
    not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="ledgerloom-"))
    return f"file://{_own_root[0]}"


_open_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Delete, on leaving, the stage tables made inside that were not kept."""
    made: list[DataFrame] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.pop()
        for df in made:
            release(df)


def adopt(df: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Let the current scope (with ``keep``, the one around it) own a table."""
    df._stage_path = path
    level = 2 if keep else 1
    if len(_open_scopes) >= level:
        _open_scopes[-level].append(df)
    return df


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    The table outlives lost executors, and later steps read only the columns
    they use.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return adopt(spark.read.schema(df.schema).parquet(path), path, keep)


def counted(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """``durable`` with the number of rows that meet ``condition``, taken while they are written."""
    seen = Observation()
    stored = durable(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return stored, seen.get["n"]


def release(df: DataFrame) -> None:
    """Delete a stage table that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path is None:
        return
    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.delete_dir(at)
    df._stage_path = None
