"""Connectivity transitions, in batch and as a stream, and replication on a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import replicate
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.store import TableStore

INTERVAL = "20 minutes"


def transitions(states: DataFrame, key: str, time: str, online: str, tie: str) -> DataFrame:
    """Rows (``key, time, online`` boolean) at which a key comes online after it was offline. A first row is no transition."""
    before = F.lag(online).over(Window.partitionBy(key).orderBy(time, tie))
    return states.withColumn("_before", before).filter(F.col(online) & ~F.col("_before")).drop("_before")


def transition_stream(states: DataFrame, key: str, time: str, online: str) -> DataFrame:
    """The same over a stream, with the last state of each key kept between batches: ``key string, time timestamp``."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in [pd.concat(list(parts)).sort_values("time", kind="stable")]:
            found = []
            for at, now in zip(part["time"], part["online"]):
                if now and last is False:
                    found.append(at)
                last = bool(now)
            state.update((last,))
            yield pd.DataFrame({"key": [name[0]] * len(found), "time": pd.Series(found, dtype="datetime64[ns]")})

    slim = states.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(online).alias("online"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, time timestamp", "online boolean", "append", GroupStateTimeout.NoTimeout)


def replicate_once(cloud: TableStore, local: TableStore, version: str | None = None, index: InvertedIndex | None = None) -> dict[str, int]:
    """One run, and one commit if something changed: pulls what is new (with ``version`` also what changed there), drops what is stale.

    Rows that stay are neither moved nor written. The ``index`` then follows, also where an earlier run was lost before it did. A local change that comes between raises ``Conflict``.
    """
    there, state = cloud.read(), local.state()
    here = local.places(state, ["id"] if version is None else ["id", version])
    stale = replicate.stale(there, here).select("_file", "_pos")
    done = local.change(replicate.to_pull(there, here, "id", version).dropDuplicates(["id"]), stale, "id", state)
    if index is not None:
        index.follow(local)
    return {"vectors_added": done["added"], "vectors_deleted": done["deleted"] - done["replaced"]}


def replicate_on(trigger: DataFrame, cloud: TableStore, local: TableStore, checkpoint: str, once: bool = False, version: str | None = None, index: InvertedIndex | None = None) -> StreamingQuery:
    """Replicates whenever ``trigger`` has rows, at most every 20 minutes; one checkpoint runs one query at a time."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            replicate_once(cloud, local, version, index)

    out = trigger.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=INTERVAL)).start()
