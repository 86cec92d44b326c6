"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; choose one only where none is set (tests, local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chainloom-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked to be sent to all tasks if it has at most ``most_rows`` rows, as it is otherwise; give it something durable, for it is counted."""
    return F.broadcast(df) if df.count() <= most_rows else df
