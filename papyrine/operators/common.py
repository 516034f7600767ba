"""What several operators need: cutting lineage, checked broadcasts, trimming."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only on a single machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if current:
        return current
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"papyrine-{os.getpid()}")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder, so that loops do not grow their plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only if df has at most ``rows`` rows; otherwise leave the join to shuffle.

    df should be cut or cheap: it is counted (up to rows + 1).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trimmed(c: Column) -> Column:
    """c without surrounding white space of any kind (tabs, no-break spaces, line ends)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
