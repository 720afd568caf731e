"""A versioned table of points on a folder that all executors share: files that never change, and a log of which of them count."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.commits import Commits
from lodestone.operators.stages import stored
from lodestone.schema import CHUNK

POINT = f"id string, vector array<float>, {CHUNK}"
#: Deleted rows that every task may hold when the table is read; more are joined.
MOST_DELETED = 1 << 20
#: How many commits tell only what they change, before one names all files again.
SHORT_COMMITS = 16


def id_bucket(digits: int, key: str = "id") -> Column:
    """The first hex digits of the md5 of an id."""
    return F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, digits)


@dataclass(frozen=True)
class File:
    """A file by its path under ``data``, its rows, how many of them are deleted, and the range of what it is clustered by."""

    path: str
    rows: int
    deleted: int = 0
    low: str | None = None
    high: str | None = None


@dataclass
class State:
    """One version: files by name, and folders of deleted rows under ``deletes`` with their numbers of rows."""

    version: int = 0
    files: dict[str, File] = field(default_factory=dict)
    deletes: dict[str, int] = field(default_factory=dict)
    since_whole: int = 0


class TableStore:
    """Points under ``root``.

    A change writes new files, and lists the places of rows that it replaces or deletes; files that are there are neither rewritten nor removed.
    It is one commit, which names them; readers of an older version go on with theirs. A change made from a version that is no longer the newest
    raises ``Conflict`` and leaves the table as it is, as does one that fails before its commit. The driver holds a line a file, as
    Spark's own file index does; rows, also those that go, stay in Spark.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str = POINT, bucket: int = 0):
        """Files are clustered by ``source``, or, with ``bucket`` n, by the first n hex digits of the id's md5 and in that order."""
        self.spark, self.root, self.schema, self.bucket = spark, root.rstrip("/"), schema, bucket
        self.commits = Commits(spark, root)
        self.types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        self.names = list(self.types)
        self.cluster = id_bucket(bucket) if bucket else F.col("source") if "source" in self.types else F.lit(None).cast("string")

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return self.commits.version()

    def state(self, version: int | None = None) -> State:
        v = self.version() if version is None else version
        told, at = [], v
        while at:
            told.append(self.commits.read(at))
            if told[-1]["whole"]:
                break
            at -= 1
        state = State(v, since_whole=len(told) - 1)
        for commit in reversed(told):
            for name in commit["removed"]:
                state.files.pop(name, None)
            for entry in commit["files"]:
                state.files[entry["path"].rpartition("/")[2]] = File(**entry)
            state.deletes |= commit["deletes"]
        return state

    def read(self, version: int | None = None) -> DataFrame:
        return self.places(self.state(version)).select(*self.names)

    def files_within(self, state: State, within: list[str]) -> dict[str, File]:
        """Files that can hold rows of some of these sources or buckets."""
        wanted, found = sorted(within), {}
        for name, f in state.files.items():
            i = bisect_left(wanted, f.low) if f.low is not None else len(wanted)
            if i < len(wanted) and wanted[i] <= f.high:
                found[name] = f
        return found

    def places(self, state: State, columns: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
        """Live rows with ``_file`` and ``_pos``; ``within`` leaves out files that can't hold rows of some sources or buckets."""
        files = list((state.files if within is None else self.files_within(state, within)).values())
        wanted = self.names if columns is None else columns
        parts = []
        for dirty in (False, True):
            paths = [f"{self.root}/data/{f.path}" for f in files if bool(f.deleted) == dirty and f.rows > f.deleted]
            if not paths:
                continue
            rows = self.spark.read.schema(self.schema).parquet(*paths).select(*wanted, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
            if dirty:
                gone = self.spark.read.schema("_file string, _pos bigint").parquet(*(f"{self.root}/deletes/{d}" for d in state.deletes))
                gone = F.broadcast(gone) if sum(state.deletes.values()) <= MOST_DELETED else gone
                rows = rows.join(gone, ["_file", "_pos"], "left_anti")
            parts.append(rows)
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, _file string, _pos bigint").select(*wanted, "_file", "_pos")
        return reduce(DataFrame.unionByName, parts)

    def added_since(self, version: int) -> DataFrame | None:
        """The rows that have come since a version, or None if others have gone."""
        old, now = self.state(version), self.state()
        if any(n not in now.files or now.files[n].deleted > f.deleted for n, f in old.files.items()):
            return None
        return self.places(State(now.version, {n: f for n, f in now.files.items() if n not in old.files}, now.deletes)).select(*self.names)

    def _written(self, df: DataFrame, max_records: int) -> dict[str, File]:
        """Writes ``df`` as new files, clustered so that a filter on source or bucket skips files."""
        folder = str(uuid.uuid4())
        have = df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in self.types.items()))
        if self.bucket:
            have = have.repartitionByRange(self.cluster)
        out = have.sortWithinPartitions(self.cluster) if self.bucket or "source" in self.names else have
        out.write.option("maxRecordsPerFile", max_records).parquet(f"{self.root}/data/{folder}")
        each = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.min(self.cluster).alias("low"), F.max(self.cluster).alias("high"))
        return {r.name: File(f"{folder}/{r.name}", r.rows, 0, r.low, r.high) for r in each.toLocalIterator()}

    def change(self, add: DataFrame | None = None, gone: DataFrame | None = None, replace: str | None = None, state: State | None = None, max_records: int = 1_000_000) -> dict[str, int]:
        """One commit: rows that ``gone`` (``_file, _pos``) tells go, as do those that agree with ``add`` in ``replace``; rows of ``add`` come.

        Returns ``version, added, deleted`` and, of those, ``replaced``; a change of nothing makes no version.
        """
        state = state or self.state()
        new = self._written(add, max_records) if add is not None else {}
        replaced = 0
        if new and replace and state.files:
            keys = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/data/{f.path}" for f in new.values())).select(replace).distinct()
            same = stored(self.places(state, [replace]).join(keys, replace, "left_semi").select("_file", "_pos"))
            replaced = same.count()
            gone = same if gone is None else gone.unionByName(same).distinct()
        touched, deletes = [], {}
        if gone is not None:
            folder = str(uuid.uuid4())
            gone.write.parquet(f"{self.root}/deletes/{folder}")
            each = self.spark.read.schema("_file string, _pos bigint").parquet(f"{self.root}/deletes/{folder}").groupBy("_file").count()
            touched = [(state.files[r[0]], r[1]) for r in each.toLocalIterator()]
            deletes = {folder: sum(n for _, n in touched)} if touched else {}
        if not new and not touched:
            return {"version": state.version, "added": 0, "deleted": 0, "replaced": 0}
        files = [*new.values(), *(File(f.path, f.rows, f.deleted + n, f.low, f.high) for f, n in touched)]
        version = self._commit(state, files, [], deletes)
        return {"version": version, "added": sum(f.rows for f in new.values()), "deleted": sum(deletes.values()), "replaced": replaced}

    def _commit(self, state: State, files: list[File], removed: list[str], deletes: dict[str, int], whole: bool = False) -> int:
        if not whole and state.since_whole + 1 >= SHORT_COMMITS:
            kept = {n: f for n, f in state.files.items() if n not in removed} | {f.path.rpartition("/")[2]: f for f in files}
            files, removed, deletes, whole = list(kept.values()), [], state.deletes | deletes, True
        return self.commits.commit(state.version + 1, {"whole": whole or not state.version, "files": [vars(f) for f in files], "removed": removed, "deletes": deletes})

    def publish(self, df: DataFrame, max_records: int = 1_000_000) -> int:
        """``df`` as the whole next version; earlier ones stay readable by number."""
        state = self.state()
        return self._commit(state, list(self._written(df, max_records).values()), [], {}, whole=True)

    def upsert(self, points: DataFrame) -> int:
        """Inserts, and replaces what has the same id; of several rows of one id in ``points`` one is taken."""
        return self.change(points.dropDuplicates(["id"]), replace="id")["version"]

    def replace_sources(self, rows: DataFrame, sources: DataFrame) -> dict[str, int]:
        """One commit: all rows of the ``sources`` go, ``rows`` come."""
        state = self.state()
        gone = self.places(state, ["source"]).join(sources.select("source").distinct(), "source", "left_semi")
        return self.change(rows, gone.select("_file", "_pos"), state=state)

    def delete_by_source(self, source: str) -> int:
        """How many rows went. Only files whose range of sources holds it are read."""
        state = self.state()
        if source is None:
            return 0
        return self.change(gone=self.places(state, ["source"], None if self.bucket else [source]).filter(F.col("source") == F.lit(source)).select("_file", "_pos"), state=state)["deleted"]

    def delete_by_ids(self, ids: DataFrame) -> int:
        state = self.state()
        return self.change(gone=self.places(state, ["id"]).join(ids.select("id").distinct(), "id", "left_semi").select("_file", "_pos"), state=state)["deleted"]

    def delete_where(self, condition: Column) -> int:
        state = self.state()
        return self.change(gone=self.places(state).filter(condition).select("_file", "_pos"), state=state)["deleted"]

    def compact(self, share: float = 0.2, small: int = 100_000, max_records: int = 1_000_000) -> int:
        """Rewrites files of which more than ``share`` is deleted, and those of fewer than ``small`` rows if there are several; the rows stay the same."""
        state = self.state()
        little = [f for f in state.files.values() if f.rows < small]
        worn = {f.path: f for f in state.files.values() if f.deleted > share * f.rows} | ({f.path: f for f in little} if len(little) > 1 else {})
        if not worn:
            return state.version
        old = State(state.version, {f.path.rpartition("/")[2]: f for f in worn.values()}, state.deletes)
        tasks = max(1, sum(f.rows - f.deleted for f in worn.values()) // max_records)
        rows = self.places(old).select(*self.names)
        new = self._written(rows.repartitionByRange(tasks, self.cluster) if self.bucket or "source" in self.names else rows.repartition(tasks), max_records)
        kept = [f for f in state.files.values() if f.path not in worn]
        # Places in files that are no longer named match nothing, so a folder stays only while one of its files does.
        deletes = state.deletes if any(f.deleted for f in kept) else {}
        return self._commit(state, [*kept, *new.values()], [], deletes, whole=True)

    def get(self, ids: DataFrame) -> DataFrame:
        """The points of the given ids."""
        return self.read().join(ids.select("id"), "id", "left_semi")

    def all_ids(self, *fields: str) -> DataFrame:
        return self.places(self.state(), ["id", *fields]).select("id", *fields)

    def count(self) -> int:
        """How many rows there are, as the log tells."""
        return sum(f.rows - f.deleted for f in self.state().files.values())

    def reset(self) -> int:
        """Publishes an empty version; earlier ones stay readable by number."""
        return self._commit(self.state(), [], [], {}, whole=True)
