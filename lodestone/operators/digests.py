"""Digests of a store's rows in a tree over buckets of ids, kept beside it, so that two stores find what differs without reading the rest.

A leaf is a bucket: the first hex digits of an id's md5. A node has the number of its rows and two sums of hashes over the columns that tell a row's
version. Sums of parts add up, so rows that come are added to the tree that is there.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import replicate
from lodestone.operators.commits import Commits
from lodestone.operators.stages import stored
from lodestone.operators.store import TableStore, id_bucket

DEPTH = 3
_NODE = "node string, n bigint, a decimal(38,0), b decimal(38,0)"


class Digests:
    """``root/nodes/<name>/level=<l>``, with a log of which of them belongs to which version of the store.

    ``columns`` tell a row and its version. Two trees are comparable if they agree in ``columns`` and ``depth``: there are 16 to the power of
    ``depth`` leaves, whose names, where they differ, come to the driver.
    """

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = ("id",), depth: int = DEPTH):
        self.spark, self.root, self.columns, self.depth = spark, root.rstrip("/"), columns, depth
        self.commits = Commits(spark, root)

    def _state(self) -> dict:
        v = self.commits.version()
        return self.commits.read(v) | {"version": v} if v else {"version": 0, "of": 0, "name": None}

    def level(self, level: int) -> DataFrame:
        """The nodes of a level, 0 for the root."""
        name = self._state()["name"]
        if name is None:
            return self.spark.createDataFrame([], _NODE)
        return self.spark.read.schema(f"{_NODE}, level int").parquet(f"{self.root}/nodes/{name}").filter(F.col("level") == level).drop("level")

    def follow(self, store: TableStore) -> int:
        """Brings the tree to the store's newest version. Reads only what has come, if nothing has gone, and only the id and version columns."""
        state, now = self._state(), store.version()
        if state["of"] == now:
            return now
        new = store.added_since(state["of"]) if state["name"] else None
        rows = store.read(now) if new is None else new
        told = [F.col(c).cast("string") for c in self.columns]
        sums = lambda df: df.groupBy("node").agg(F.sum("n").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
        each = rows.select(id_bucket(self.depth).alias("node"), F.lit(1).cast("bigint").alias("n"), *(F.xxhash64(F.lit(i), *told).cast("decimal(20,0)").alias(c) for i, c in enumerate("ab")))
        leaves = stored(sums(each if new is None else sums(each).unionByName(self.level(self.depth))))
        levels = [leaves.select(F.substring("node", 1, l).alias("node"), "n", "a", "b") for l in range(self.depth)]
        whole = reduce(DataFrame.unionByName, (sums(x).withColumn("level", F.lit(l)) for l, x in enumerate([*levels, leaves])))
        name = str(uuid.uuid4())
        whole.coalesce(1 + 16**self.depth // 65_536).write.partitionBy("level").parquet(f"{self.root}/nodes/{name}")
        self.commits.commit(state["version"] + 1, {"of": now, "name": name})
        return now

    def differing(self, other: Digests) -> list[str]:
        """Names of leaves that differ, found from the root down: of each level only the children of nodes that differ are compared."""
        if (self.columns, self.depth) != (other.columns, other.depth):
            raise ValueError("trees of other columns or depth can't be compared")
        names: list[str] | None = None
        for level in range(self.depth + 1):
            ours, theirs = self.level(level), other.level(level)
            if names is not None:
                parent = F.substring("node", 1, level - 1) if level > 1 else F.lit("")
                ours, theirs = (x.filter(parent.isin(names)) for x in (ours, theirs))
            both = ours.join(theirs.select("node", *(F.col(c).alias(f"_{c}") for c in "nab")), "node", "full_outer")
            same = F.col("n").eqNullSafe(F.col("_n")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))
            names = sorted(r[0] for r in both.filter(~same).select("node").collect())
            if not names:
                return []
        return names


def replicate_by_digests(cloud: TableStore, local: TableStore, there: Digests, here: Digests, version: str | None = None) -> dict[str, int]:
    """``sync.replicate_once`` for stores clustered by buckets of ids: only files of buckets that differ are read.

    The trees must be of ``id``, or of ``id`` and ``version``. Returns its counts, with those of buckets and files that were read.
    """
    there.follow(cloud), here.follow(local)
    buckets = there.differing(here)
    counts = {"vectors_added": 0, "vectors_deleted": 0, "buckets": len(buckets), "files_read": 0}
    if not buckets:
        return counts
    far, state = cloud.state(), local.state()
    names = {b[: min(len(b), cloud.bucket)] for b in buckets}, {b[: min(len(b), local.bucket)] for b in buckets}
    differs = id_bucket(there.depth).isin(buckets)
    rows = cloud.places(far, within=sorted(names[0]) if cloud.bucket else None).filter(differs).select(*cloud.names)
    mine = local.places(state, ["id"] if version is None else ["id", version], sorted(names[1]) if local.bucket else None).filter(differs)
    stale = replicate.stale(rows, mine).select("_file", "_pos")
    done = local.change(replicate.to_pull(rows, mine, "id", version).dropDuplicates(["id"]), stale, "id", state)
    here.follow(local)
    files = [len(s.files_within(st, sorted(n))) if s.bucket else len(st.files) for s, st, n in ((cloud, far, names[0]), (local, state, names[1]))]
    return counts | {"vectors_added": done["added"], "vectors_deleted": done["deleted"] - done["replaced"], "files_read": sum(files)}
