"""The inverted index: equal to a search of all texts, whatever it skips; what it reads; appends and versions."""

import random
import re

import pytest
from lodestone.operators import lexical
from lodestone.operators.commits import Conflict
from lodestone.operators.inverted import InvertedIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts(spark):
    """Words of very different frequency in texts of very different length; copies, so that scores tie."""
    draw = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(draw.choices(words, weight, k=draw.choice([3, 10, 40, 300])))) for i in range(1500)]
    rows += [(2000 + i, "word0 word1 rare") for i in range(40)]
    return spark.createDataFrame(rows, "id bigint, content string").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(f"word{int(400 * draw.random() ** 3)}" for _ in range(draw.randint(1, 5)))) for i in range(25)]
    return spark.createDataFrame(rows + [(80, "rare"), (81, "word0 word0 rare"), (90, "the of"), (91, None), (92, "unknown")], "query_id bigint, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    index = InvertedIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=32, block=16)
    index.append(texts)
    return index


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain(texts, asked, k):
    return rows(lexical.search(lexical.build(texts, "id", "content"), asked, k, "id", "query_id"))


@pytest.mark.parametrize("k", [1, 5, 60])
def test_equal_to_a_search_of_all(texts, asked, index, k):
    found = rows(index.search(asked, k))
    assert found == plain(texts, asked, k) and len(found) > 20
    if k == 5:
        assert rows(index.search(asked, k, most_terms=0)) == found


def test_blocks_are_skipped(asked, index):
    at = index.version()
    terms, buckets = index.asked(at, asked, "query_id", "text")
    bounds, pairs = index.reachable(at, terms, buckets, 5)
    assert pairs.count() < 0.5 * bounds.count()
    # No more candidates than hits in the blocks left.
    assert index.scored(at, terms, pairs, buckets).filter("score <= 0").count() == 0


def test_only_buckets_of_the_tokens_are_read(spark, index):
    at = index.version()
    one = spark.createDataFrame([(1, "word3 word9")], "query_id bigint, text string")
    terms, buckets = index.asked(at, one, "query_id", "text")
    assert 1 <= len(buckets) <= 2
    files = lambda b: {r[0] for r in index.postings(at, b).select("_metadata.file_path").distinct().collect()}
    read, all_ = files(buckets), files(None)
    assert len(read) < len(all_) / 5 and {f.split("bucket=")[1].split("/")[0] for f in read} == {str(b) for b in buckets}
    plan = index.scored(at, terms, index.reachable(at, terms, buckets, 5)[1], buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_one_shuffle_gathers_postings(index):
    each = index.postings(index.version()).select("bucket", "token", "block")
    plan = each.repartitionByRange(4, "bucket", "token", "block").groupBy("bucket", "token", "block").count()._jdf.queryExecution().toString()
    assert len(re.findall("Exchange", plan.split("== Physical Plan ==")[1])) == 1


def test_append_is_a_rebuild_without_reading(spark, texts, asked, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"), buckets=8, block=16)
    assert index.search(asked, 5).count() == 0
    index.append(texts.filter("id < 700"))
    first = rows(index.search(asked, 5))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert index.append(texts.filter("id >= 700")) == 2
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert rows(index.search(asked, 5)) == plain(texts, asked, 5)
    assert rows(index.search(asked, 5, version=1)) == first == plain(texts.filter("id < 700"), asked, 5)
    assert index.append(texts.filter("id = 8")) == 3 and index.version().n_docs == 1541
    index.rebuild(texts.filter("id < 100"))
    assert rows(index.search(asked, 5)) == plain(texts.filter("id < 100"), asked, 5)
    with pytest.raises(Conflict):
        index._put(index.version(2), texts.filter("id < 5"), "id", "content", keep=True)
    assert index.version().version == 4


def test_string_ids_and_rows_of_one_id(spark, tmp_path):
    docs = spark.createDataFrame([("b", "red apple"), ("a", "red apple"), (None, "green apple"), ("c", None), ("d", "green pear"), ("d", "green pear")] + [(f"e{i}", "other words") for i in range(9)], "id string, content string")
    asked = spark.createDataFrame([("q", "red"), ("r", "green")], "query_id string, text string")
    index = InvertedIndex(spark, str(tmp_path / "s"))
    index.append(docs)
    found = [(r.query_id, r.id, r["rank"]) for r in index.search(asked, 3).orderBy("query_id", "rank").collect()]
    assert found == [("q", "a", 1), ("q", "b", 2), ("r", None, 1), ("r", "d", 2), ("r", "d", 3)]
    same = lexical.search(lexical.build(docs, "id", "content"), asked, 3, "id", "query_id")
    assert found == [(r.query_id, r.id, r["rank"]) for r in same.orderBy("query_id", "rank").collect()]
    empty = InvertedIndex(spark, str(tmp_path / "e"))
    empty.append(docs.filter("false"))
    assert empty.search(asked, 3).count() == 0 and empty.version().n_docs == 0


def test_candidates_never_above_hits(spark, asked):
    draw = random.Random(8)
    docs = spark.createDataFrame([(i, f"only{i}") for i in range(1050)], "id bigint, content string").repartition(3)
    one_word = spark.createDataFrame([(i, f"only{draw.randrange(1050)}") for i in range(50)], "query_id bigint, text string")
    index = lexical.build(docs, "id", "content")
    held = lexical.query_terms(one_word, "query_id", "text").join(index.vocabulary, "token").select(F.col("query_id").alias("query"), "token", "df", (F.col("times") * F.col("idf")).alias("weight")).toArrow()
    found = index.terms.mapInArrow(lexical._passed(held, index.avgdl, 20), "query bigint, point bigint, score double")
    assert found.count() == 50


def test_postings_of_a_token_and_block_are_one_row_across_batches():
    """Runs that end in a batch, go on in the next, or fill several."""
    import pyarrow as pa

    from lodestone.operators import inverted

    sizes = [3, 1, 4, 30, 2, 2, 7, 1]
    rows = [{"bucket": k % 2, "token": f"t{k // 2}", "block": k, "doc": f"d{i}", "row": i, "tf": i % 5 + 1, "dl": 90 - i} for k, n in enumerate(sizes) for i in range(n)]
    schema = pa.schema([("bucket", pa.int32()), ("token", pa.string()), ("block", pa.int64()), ("doc", pa.string()), ("row", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32())])
    for each in (1, 3, 10, 100):
        got = [r for b in inverted._gathered(iter(pa.Table.from_pylist(rows, schema).to_batches(each))) for r in b.to_pylist()]
        assert [r["n"] for r in got] == sizes and [r["block"] for r in got] == list(range(len(sizes)))
        for r in got:
            mine = [x for x in rows if x["block"] == r["block"]]
            assert r["docs"] == [{c: x[c] for c in ("doc", "row", "tf", "dl")} for x in mine]
            assert (r["max_tf"], r["min_dl"]) == (max(x["tf"] for x in mine), min(x["dl"] for x in mine))


def test_a_search_sends_postings_and_not_hits(asked, index):
    """What is shuffled does not have a row for each hit, and sums of bounds are made by block."""
    at = index.version()
    terms, buckets = index.asked(at, asked, "query_id", "text")
    bounds, pairs = index.reachable(at, terms, buckets, 5)
    found = index.scored(at, terms, pairs, buckets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Repartition" not in plan
    joined = index.scored(at, terms, pairs, buckets, 0)
    places = lambda df: sorted((r["query"], r.point, round(r.score, 9)) for r in df.collect())
    assert places(found) == places(joined)
    best = index.scored(at, terms, pairs, buckets, k=3)
    assert best.count() <= found.count() and not best.exceptAll(found).count()
    # A posting is a place in its block and a frequency: ids and lengths stand once, with the documents.
    assert index.postings(at).schema["docs"].dataType.elementType.names == ["row", "tf"]
    assert index.documents(at).count() == at.n_docs == 1540


@pytest.mark.parametrize("parts", [3, 8, 20])
def test_packets_hold_every_posting_by_bucket(spark, texts, parts, monkeypatch):
    """Whatever a task sends at a time: the same postings, each in the partition that files its token's bucket as Spark tells it."""
    from lodestone.operators import inverted

    each = lexical.counted(texts.orderBy("id").limit(300), "id", "content").orderBy("doc").collect()
    rows = [{"block": i // 64 * 64 + r.dl % 5, "row": i % 64, "dl": r.dl, "terms": [t.asDict() for t in r.terms]} for i, r in enumerate(each) if r.dl]
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("dl", pa.int32()), ("terms", pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int32())])))])
    expected = sorted((r["block"], t["token"], r["row"], t["tf"]) for r in rows for t in r["terms"])
    bucket = {r.token: r.bucket for r in spark.createDataFrame([(t,) for t in {x[1] for x in expected}], "token string").select("token", inverted._bucket(F.col("token"), 8).alias("bucket")).collect()}
    for sent, size in ((1 << 20, 1000), (400, 7)):
        monkeypatch.setattr(inverted, "SENT", sent)
        packets = list(inverted._sent(8, parts)(iter(pa.Table.from_pylist(rows, schema).to_batches(size))))
        assert (len(packets) > 1) == (sent == 400)
        found, home = [], {}
        for packet in packets:
            for part in packet.to_pylist():
                for r in (r for b in inverted._filed(iter([pa.RecordBatch.from_pylist([part])])) for r in b.to_pylist()):
                    assert r["bucket"] == bucket[r["token"]] and 0 <= part["part"] < parts
                    assert home.setdefault(r["token"], part["part"]) == part["part"]
                    mine = [x for x in rows if x["block"] == r["block"] and x["row"] in [d["row"] for d in r["docs"]]]
                    assert r["n"] == len(r["docs"]) and r["max_tf"] == max(d["tf"] for d in r["docs"]) and r["min_dl"] == min(x["dl"] for x in mine)
                    found += [(r["block"], r["token"], d["row"], d["tf"]) for d in r["docs"]]
        assert sorted(found) == expected
