"""What Python workers hold: Arrow batches of bounded size, and memory given back when a task ends."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, about (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches by bytes and not only by rows: a batch of as many rows as a partition has grows with it, and with the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
