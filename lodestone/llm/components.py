"""Connected components of an edge table by alternating large and small stars, with lineage cut in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Uses the folder that ``spark.checkpoint.dir`` names. Where there is none, a local session gets one of its own; a cluster must name one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def connected(edges: DataFrame) -> DataFrame:
    """From edges ``a, b``: ``node, root`` for each node that is not itself the smallest of its component."""
    ensure_checkpoint_dir(edges)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        # Large star: each node hands its larger neighbours to the least of all its neighbours and itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        now = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node hands its smaller neighbours, and itself, to the least of them.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().checkpoint()
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def of_class(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their class; ``classes`` has one row a ``key``, with ``copies``, its number of rows.

    Classes of over a ``HOT``-th of all rows, of which there are fewer than ``HOT``, are broadcast, so that no class's rows meet in one task.
    """
    total = classes.agg(F.sum("copies")).first()[0] or 0
    large = F.col("copies") * HOT > total
    hot = F.broadcast(classes.filter(large).drop("copies"))
    others = rows.join(hot.select(key), key, "left_anti").join(classes.filter(~large).drop("copies"), key)
    return rows.join(hot, key).unionByName(others)
