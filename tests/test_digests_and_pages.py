"""Replication that reads differing buckets only, and pages that open the files that hold them."""

import random

import pytest
from lodestone.operators import replicate
from lodestone.operators.digests import Digests, replicate_by_digests
from lodestone.operators.pages import Pages
from lodestone.operators.store import TableStore, id_bucket
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<float>, source string, version int"


def rows(spark, ids, version=1):
    return spark.createDataFrame([(str(i), [float(i)], f"s{i % 3}", version) for i in ids], SCHEMA)


@pytest.fixture
def pair(spark, tmp_path):
    stores = [TableStore(spark, str(tmp_path / n), SCHEMA, bucket=2) for n in ("cloud", "local")]
    trees = [Digests(spark, str(tmp_path / f"{n}-tree"), ("id", "version"), depth=2) for n in ("cloud", "local")]
    for store in stores:
        store.publish(rows(spark, range(2000)).repartition(8), max_records=100)
    return *stores, *trees


def test_only_differing_buckets_are_read(spark, pair):
    cloud, local, there, here = pair
    assert replicate_by_digests(*pair, "version") == {"vectors_added": 0, "vectors_deleted": 0, "buckets": 0, "files_read": 0}
    cloud.upsert(rows(spark, [7, 3000], 2))
    cloud.delete_by_ids(rows(spark, [11]))
    expected = {(r.id, r.version) for r in replicate.synced(cloud.read(), local.read(), "id", "version").collect()}
    n_files = len(cloud.state().files) + len(local.state().files)
    done = replicate_by_digests(*pair, "version")
    assert (done["vectors_added"], done["vectors_deleted"]) == (2, 1) and done["buckets"] <= 3 and done["files_read"] < n_files / 3
    assert {(r.id, r.version) for r in local.read().collect()} == expected
    assert there.differing(here) == [] and replicate_by_digests(*pair, "version")["buckets"] == 0
    # Files of other buckets could be missing: they are not opened.
    state = cloud.state()
    wanted = [r[0] for r in rows(spark, [7]).select(id_bucket(2)).collect()]
    read = {r[0] for r in cloud.places(state, ["id"], wanted).select("_file").distinct().collect()}
    assert read <= set(cloud.files_within(state, wanted)) and len(read) < len(state.files) / 3


def test_trees(spark, pair, tmp_path):
    cloud, _, there, _ = pair
    there.follow(cloud)
    root = there.level(0).first()
    assert root.n == 2000 and there.level(1).count() == 16 and there.level(2).agg(F.sum("n"), F.sum("a")).first() == (2000, root.a)
    # What comes is added to the tree; the result is that of a tree made anew.
    cloud.upsert(rows(spark, range(5000, 5040)))
    there.follow(cloud)
    anew = Digests(spark, str(tmp_path / "anew"), ("id", "version"), depth=2)
    anew.follow(cloud)
    assert there.differing(anew) == [] and there.level(0).first() == anew.level(0).first()
    with pytest.raises(ValueError):
        there.differing(Digests(spark, str(tmp_path / "x"), ("id",), depth=2))
    empty = Digests(spark, str(tmp_path / "empty"), ("id", "version"), depth=2)
    assert len(there.differing(empty)) == there.level(2).count()


def test_pages(spark, tmp_path):
    draw = random.Random(1)
    ids = draw.sample(range(100_000), 1234)
    table = spark.createDataFrame([(i, f"k{i % 7}") for i in ids], "id bigint, k string").repartition(5)
    pages = Pages(spark, str(tmp_path / "p"))
    pages.write(table, "id", each=50)
    for offset, limit in ((0, 1), (0, 100), (49, 2), (777, 300), (1200, 50), (1233, 1), (1234, 5), (9999, 5)):
        got = pages.page(offset, limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, replicate.page_of(table, "id", offset, limit).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan and "TakeOrdered" not in plan
    assert pages.page(60, 20)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    same = sorted(r.id for r in pages.page_without_repeats(100, 60, "k").collect())
    assert same == sorted(r.id for r in replicate.export_page(table, "id", "k", 100, 60).collect()) and len(same) == 7
    pages.write(table.filter("id < 500"), "id")
    assert pages.page(0, 5, version=1).first().total == 1234
    pages.write(table.filter("false"), "id")
    assert pages.page(0, 5).count() == 0
    with pytest.raises(ValueError):
        pages.page(0, 3001)
