"""Session helpers: shared scratch space and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only for an unconfigured local session."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call gives another one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor re-reads it instead of recomputing."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, row_bytes: int = 256, max_bytes: int = 64 << 20) -> DataFrame:
    """Compute ``df`` once, then broadcast it if its counted rows of about ``row_bytes`` fit ``max_bytes``.

    A larger one is left to Catalyst, which shuffles and splits skewed keys at run time.
    """
    computed = materialize(df)
    return F.broadcast(computed) if is_small(computed, max_bytes // row_bytes) else computed
