"""Table blocks, recognised words, images, registry, log, overlap, export pages and etags."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import context, replicate
from lodestone.sources import files


def test_table_blocks(spark):
    tables = spark.createDataFrame([("a.pdf", 3, 2, [["A", "B"], ["1", "2"]])], "source string, page int, n int, rows array<array<string>>")
    block = files.table_blocks(tables).first()
    assert block.content.startswith("[TABLE 2 — Page 3]\n| A | B |\n|---|---|\n| 1 | 2 |") and block.type == "table"


def test_recognised_words(spark):
    rows = [("x.png", 0, " Oil ", 91.0), ("x.png", 1, " ", 80.0), ("x.png", 2, "level", 90.5), ("x.png", 3, "bad", 0.9), ("x.png", 4, "low", -1.0), ("y.png", 0, "", 5.0)]
    got = {r.image_path: r for r in files.recognised(spark.createDataFrame(rows, "image_path string, ord int, word string, confidence double")).collect()}
    assert (got["x.png"].text, got["x.png"].confidences, got["x.png"].avg_confidence) == ("Oil level", [91.0, 90.5], 90.75)
    assert (got["y.png"].text, got["y.png"].words, got["y.png"].avg_confidence) == ("", [], 0.0)


def test_shown_images(spark):
    ranked = spark.createDataFrame([(1, 1, "image", "/a/x.png"), (1, 2, "image", "/gone/y.png"), (1, 3, "image", "/gone/z.png"), (1, 4, "text", "/a/x.png"), (1, 5, "image", None)], "query_id int, rank int, type string, image_path string")
    present = spark.createDataFrame([("/a/x.png",), ("/img/x.png",), ("/img/y.png",)], "path string")
    assert sorted((r["rank"], r.image_path) for r in files.shown_images(ranked, present, "/img/").collect()) == [(1, "/a/x.png"), (2, "/img/y.png")]


def test_registry_and_log(spark, tmp_path):
    files.save_registry(spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], files.REGISTRY), f"{tmp_path}/r1")
    files.save_registry(files.without_file(files.registry(spark, f"{tmp_path}/r1"), "a"), f"{tmp_path}/r2")
    assert sorted(r.sha256 for r in files.registry(spark, f"{tmp_path}/r2").collect()) == ["2", "3"]
    for i in range(3):
        files.append_log(spark, f"{tmp_path}/log", {"vectors_added": i, "errors": ["e"] * i})
    last = replicate.last_log(files.log(spark, f"{tmp_path}/log"), 2).collect()
    assert [(r.vectors_added, r.errors) for r in last] == [(2, ["e", "e"]), (1, ["e"])]


def test_overlap_and_pages(spark):
    rows = spark.createDataFrame([(i, "s", 1, f"c{i % 3}") for i in range(6)], "id int, source string, page int, content string")
    assert tuple(replicate.overlap(rows, rows.filter("id IN (0, 3, 4)")).first()) == (3, 2, 2)
    page = replicate.export_page(rows, "id", "content", 1, 4).collect()
    assert sorted(r.id for r in page) == [1, 2, 3] and all(r.total == 6 and r.has_more for r in page)


def test_etags(spark):
    points = spark.createDataFrame([(str(i),) for i in range(500)], "id string").repartition(4)
    flat, deep = (replicate.fingerprint(points, leaf=n).first().etag for n in (1000, 0.005))
    assert flat != deep and deep == replicate.fingerprint(points.repartition(2), leaf=0.005).first().etag
    assert replicate.exact_fingerprint(points).first().etag == hashlib.md5(",".join(sorted(map(str, range(500)))).encode()).hexdigest()
    with pytest.raises(ValueError):
        replicate.exact_fingerprint(points, most=100)


def test_boxes_and_limits(spark):
    row = spark.range(1).select(vectors.box_text(F.array(F.lit(1.5), F.lit(2.0))).alias("t"), vectors.box(F.lit("[1.5,2.0]")).alias("b"), vectors.box(F.lit("no")).alias("n")).first()
    assert (row.t, row.b, row.n) == ("[1.5,2.0]", [1.5, 2.0], None)
    asked = spark.createDataFrame([(1, "q", "s"), (2, "q", "s" * 65), (3, "q", None)], "query_id int, text string, session_id string")
    assert sorted(r.query_id for r in context.valid_questions(asked).collect()) == [1, 3]
