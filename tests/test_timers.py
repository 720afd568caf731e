"""Commands of the timed stream: delay, period, edge, one run at a time; over batches and restarts; changed rows come."""

import pytest
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.store import TableStore
from lodestone.streaming import timers
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<float>, source string, content string, version int"


@pytest.fixture(autouse=True)
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.PROVIDER)
    yield
    spark.conf.set(name, before)


#: When the stories begin.
START = 1_700_000_000
#: Seconds and what is told: polls, and (None) the end of a run.
STORY = [(0, True), (15, True), (32, None), (600, True), (700, False), (900, True), (905, None), (1000, False), (1100, True), (1231, True), (1300, None), (2400, True), (2431, None), (3000, False), (3700, False), (4000, True), (4001, None), (5000, True)]
RUNS = [(30, "start"), (900, "edge"), (1100, "edge"), (2430, "period"), (4000, "edge"), (4830, "period")]


def write(spark, rows, folder):
    spark.createDataFrame(rows, "key string, s bigint, online boolean").coalesce(1).write.json(folder)


def run(spark, folder, state):
    events = spark.readStream.schema("key string, s bigint, online boolean").option("maxFilesPerTrigger", 1).json(f"{folder}/*").withColumn("time", F.timestamp_seconds(F.col("s") + START))
    out = f"{state}-out"
    timers.commands(events, "key", "time", "online", late="1 second").writeStream.format("json").outputMode("append").option("checkpointLocation", str(state)).trigger(availableNow=True).start(out).awaitTermination(240)
    return sorted((r.s, r.reason) for r in spark.read.schema("key string, time timestamp, reason string").json(out).select((F.unix_seconds("time") - START).alias("s"), "reason").collect())


def test_plain_schedule():
    s, found = timers.Schedule(), []
    for at, online in STORY:
        found += s.told(1000 * at, online)
    assert [(at // 1000, why) for at, why in found] == RUNS


@pytest.mark.parametrize("cuts", [[], [4, 9]])
def test_stream_and_restart(spark, tmp_path, cuts):
    edges = [0, *cuts, len(STORY)]
    parts = [STORY[a:b] for a, b in zip(edges, edges[1:])]
    folder = str(tmp_path / "in")
    for k, part in enumerate(parts):
        write(spark, [("app", *x) for x in part], f"{folder}/{k}")
        found = run(spark, folder, tmp_path / "state")
    assert found == RUNS


def test_a_period_passes_without_polls(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, [("app", 0, True), ("app", 31, None)], f"{folder}/0")
    run(spark, folder, tmp_path / "state")
    # Another key's time moves on: the timer goes off although the first key says nothing.
    write(spark, [("other", 1500, False), ("app", 20, False)], f"{folder}/1")
    # What is told late (20 s, after 31 s) is left out.
    assert run(spark, folder, tmp_path / "state") == [(30, "start"), (1230, "period")]


def test_replication_when_due(spark, tmp_path):
    cloud, local = (TableStore(spark, str(tmp_path / n), SCHEMA) for n in ("cloud", "local"))
    index = InvertedIndex(spark, str(tmp_path / "index"))
    rows = lambda v, *ids: spark.createDataFrame([(str(i), [1.0], "s", f"word{i} v{v}", v) for i in ids], SCHEMA)
    cloud.publish(rows(1, 1, 2))
    spark.createDataFrame([("app", "start")], "key string, reason string").write.json(str(tmp_path / "due"))
    due = spark.readStream.schema("key string, reason string").json(str(tmp_path / "due"))
    timers.replicate_when_due(due, cloud, local, str(tmp_path / "c"), "version", index, once=True).awaitTermination(120)
    assert local.count() == 2 and index.version().of == local.version()
    cloud.upsert(rows(2, 2))
    spark.createDataFrame([("app", "period"), ("app", "edge")], "key string, reason string").write.mode("append").json(str(tmp_path / "due"))
    timers.replicate_when_due(due, cloud, local, str(tmp_path / "c"), "version", index, once=True).awaitTermination(120)
    assert {r.id: r.version for r in local.read().collect()} == {"1": 1, "2": 2} and local.version() == 2 and index.version().of == 2
