"""The table store: what a change writes, who may commit, compaction, and versions."""

import glob
import os

import pytest
from lodestone.operators import store as stores
from lodestone.operators.commits import Conflict
from lodestone.operators.store import TableStore
from lodestone.streaming import sync
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<float>, source string, content string"


def rows(spark, *ids, content="x", source=lambda i: f"s{i % 10}"):
    return spark.createDataFrame([(str(i), [1.0, float(i)], source(i), content) for i in ids], SCHEMA)


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/data/*/*.parquet")}


def held(store, version=None):
    return {r.id: r.content for r in store.read(version).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "t"), SCHEMA)


def test_a_small_upsert_rewrites_nothing(spark, store):
    store.publish(rows(spark, *range(1000)).repartition(4), max_records=100)
    before = files(store.root)
    assert len(before) >= 10
    store.upsert(rows(spark, *range(500, 510), 5000, content="new"))
    after = files(store.root)
    assert {f: after[f] for f in before} == before
    new = spark.read.parquet(*(f for f in after if f not in before))
    assert new.count() == 11
    state = store.state()
    assert sum(f.deleted for f in state.files.values()) == 10 and store.count() == 1001
    assert held(store) == {str(i): "new" if 500 <= i < 510 or i == 5000 else "x" for i in [*range(1000), 5000]}
    assert held(store, 1) == {str(i): "x" for i in range(1000)}


def test_second_writer_and_failed_writer(spark, store):
    store.publish(rows(spark, 1, 2, 3))
    old = store.state()
    store.upsert(rows(spark, 4))
    with pytest.raises(Conflict):
        store.change(rows(spark, 9), replace="id", state=old)
    with pytest.raises(Conflict):
        store.commits.commit(2, {})
    assert store.version() == 2 and set(held(store)) == {"1", "2", "3", "4"}
    broken = rows(spark, 7).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    assert store.version() == 2 and set(held(store)) == {"1", "2", "3", "4"}
    assert store.change(rows(spark, 9), replace="id")["version"] == 3


def test_deletes_read_only_files_of_the_source(spark, store):
    store.publish(rows(spark, *range(100), source=lambda i: f"s{i // 10}").repartitionByRange(10, "source"))
    places = store.places(store.state(), ["source"], ["s3"])
    assert places.select("_file").distinct().count() < 10
    assert store.delete_by_source("s3") == 10 and store.delete_by_source("s3") == 0 and store.version() == 2
    assert store.delete_by_ids(rows(spark, 1, 2, 31, 500)) == 2 and store.count() == 88 and store.read().count() == 88
    assert store.delete_where(F.col("id") == "99") == 1
    assert store.get(rows(spark, 1, 5, 99)).count() == 1


@pytest.mark.parametrize("most", [stores.MOST_DELETED, 0])
def test_compaction(spark, store, monkeypatch, most):
    monkeypatch.setattr(stores, "MOST_DELETED", most)
    store.publish(rows(spark, *range(200)).repartition(4))
    store.delete_by_ids(rows(spark, *range(0, 200, 2)))
    store.upsert(rows(spark, *range(300, 310)))
    before, version = held(store), store.version()
    assert store.compact(share=0.2, small=0) == version + 1
    assert held(store) == before and held(store, version) == before
    assert all(f.deleted == 0 for f in store.state().files.values()) and store.state().deletes == {}
    assert store.compact(share=0.2, small=0) == version + 1
    store.delete_by_ids(rows(spark, 1))
    store.compact(share=0.9, small=1000)
    assert len(store.state().files) == 1 and set(held(store)) == set(before) - {"1"}


def test_long_log(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "SHORT_COMMITS", 3)
    for i in range(8):
        store.upsert(rows(spark, i, i + 1, content=str(i)))
    assert held(store) == {str(i): str(min(i, 7)) for i in range(9)} and store.count() == 9
    assert held(store, 4) == {"0": "0", "1": "1", "2": "2", "3": "3", "4": "3"}
    assert [store.commits.read(v)["whole"] for v in range(1, 9)] == [True, False, False, True, False, False, True, False]


def test_edges(spark, store):
    assert store.version() == 0 and store.read().columns == ["id", "vector", "source", "content"] and store.count() == 0
    assert store.delete_by_source("s1") == 0 and store.compact() == 0 and store.version() == 0
    assert store.upsert(rows(spark, 1).filter("false")) == 0
    store.upsert(spark.createDataFrame([("1", None, None, None), (None, None, None, None), ("1", None, None, None)], SCHEMA))
    assert store.count() == 2 and store.delete_by_source("a") == 0
    # Extra columns, also of the names used inside, are left out.
    store.upsert(rows(spark, 2).withColumn("_file", F.lit("f")).withColumn("_pos", F.lit(0)))
    assert store.count() == 3 and store.read().columns == ["id", "vector", "source", "content"]
    store.reset()
    assert store.count() == 0 and store.read().count() == 0 and store.read(1).count() == 2


def test_replication_moves_changed_rows_only(spark, tmp_path):
    schema = SCHEMA + ", version int"
    cloud, local = (TableStore(spark, str(tmp_path / n), schema) for n in ("cloud", "local"))
    cloud.publish(rows(spark, *range(50)).withColumn("version", F.lit(1)))
    assert sync.replicate_once(cloud, local, "version") == {"vectors_added": 50, "vectors_deleted": 0}
    cloud.upsert(rows(spark, 3, 60, content="new").withColumn("version", F.lit(2)))
    cloud.delete_by_ids(rows(spark, 7, 8))
    before = files(local.root)
    spark.range(1).write.json(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id bigint").json(str(tmp_path / "ticks"))
    sync.replicate_on(ticks, cloud, local, str(tmp_path / "state"), once=True, version="version").awaitTermination(60)
    assert held(local) == held(cloud) and held(local)["3"] == "new"
    new = [f for f in files(local.root) if f not in before]
    assert spark.read.parquet(*new).count() == 2
    assert sync.replicate_once(cloud, local, "version") == {"vectors_added": 0, "vectors_deleted": 0} and local.version() == 2
