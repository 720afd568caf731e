"""Results that several later steps read, kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where that is not set, a local session gets a folder of its own; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder there, for tables that a query makes for itself."""
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4()}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once under ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
