"""Files as tables. PDF, Excel and OCR need parsers that may not be installed: they are plugins of one form, called in tasks.

A parser takes a file's bytes and gives rows; what it raises goes to a reject table, never silently away.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension, file_name, markdown

#: bytes -> dictionaries with the columns of the schema that goes with the parser.
Parser = Callable[[bytes], Iterable[dict]]
MIN_IMAGE_BYTES = 5000
MIN_OCR_CHARS = 20
_PARSERS: dict[str, tuple[Parser, str]] = {}


def register_parser(suffix: str, parser: Parser, schema: str) -> None:
    """``suffix`` like ``.pdf``; ``schema`` the DDL of the parser's rows."""
    _PARSERS[suffix.lower()] = (parser, schema)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, source, suffix, sha256, content`` of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_name(F.col("path")).alias("source"), extension(F.col("path")).alias("suffix"), F.sha2("content", 256).alias("sha256"), "content")


def accepted(files: DataFrame, *suffixes: str) -> tuple[DataFrame, DataFrame]:
    """Files of the given suffixes (whatever their case), and the others."""
    known = F.col("suffix").isin(*(s.lower() for s in suffixes))
    return files.filter(known), files.filter(~known).drop("content")


def parse(files: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all files of a suffix (with ``source`` and ``ord``), and ``source, error`` of those that failed.

    Both frames run the parser; write or cache what is used twice.
    """
    if suffix.lower() not in _PARSERS:
        raise LookupError(f"no parser for {suffix}; register_parser() takes one")
    parser, schema = _PARSERS[suffix.lower()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"]):
                try:
                    rows = [json.dumps(r, default=str) for r in parser(bytes(content))]
                    yield pd.DataFrame({"source": source, "ord": range(len(rows)), "row": rows, "error": None})
                except Exception as e:  # noqa: BLE001  a bad file is data
                    yield pd.DataFrame({"source": [source], "ord": [0], "row": [None], "error": [f"{type(e).__name__}: {e}"]})

    out = files.filter(F.col("suffix") == suffix.lower()).select("source", "content").mapInPandas(run, "source string, ord int, row string, error string")
    rows = out.filter("error IS NULL").select("source", "ord", F.from_json("row", schema).alias("r")).select("source", "ord", "r.*")
    return rows, out.filter("error IS NOT NULL").select("source", "error")


def image_blocks(images: DataFrame) -> DataFrame:
    """Blocks of images (``source, page, size, page_text, image_path``): small ones left out, the page's first 300 characters as text."""
    said = F.trim(F.regexp_replace(F.substring(F.coalesce("page_text", F.lit("")), 1, 300), r"[\r\n]+", " "))
    label = F.when(said != "", said).otherwise(F.concat(F.lit("Image on page "), F.col("page").cast("string")))
    return images.filter(F.col("size") >= MIN_IMAGE_BYTES).select("source", "page", label.alias("content"), F.lit("image").alias("type"), "image_path")


def ocr_chunks(texts: DataFrame) -> DataFrame:
    """Texts of at least 20 characters."""
    return texts.filter(F.length(F.trim("content")) >= MIN_OCR_CHARS)


def table_blocks(tables: DataFrame) -> DataFrame:
    """Blocks of tables (``source, page, n, rows``, an array of arrays of cells), each under its number and page."""
    head = F.concat(F.lit("[TABLE "), F.col("n").cast("string"), F.lit(" — Page "), F.col("page").cast("string"), F.lit("]\n"))
    return tables.select("source", "page", F.concat(head, markdown(F.col("rows"))).alias("content"), F.lit("table").alias("type"))


def recognised(words: DataFrame) -> DataFrame:
    """``image_path, text, words, confidences, avg_confidence`` of recognised words (``image_path, ord, word, confidence``).

    Blank words and those without confidence are left out; an image without any has an empty text and a mean of 0.
    """
    kept = F.when((F.trim("word") != "") & (F.col("confidence").cast("int") > 0), F.struct("ord", F.trim("word").alias("word"), F.col("confidence").cast("double").alias("c")))
    each = words.groupBy("image_path").agg(F.array_sort(F.collect_list(kept)).alias("w"), F.bround(F.avg(kept["c"]), 2).alias("mean"))
    return each.select("image_path", F.array_join("w.word", " ").alias("text"), F.col("w.word").alias("words"), F.col("w.c").alias("confidences"), F.coalesce("mean", F.lit(0.0)).alias("avg_confidence"))


def shown_images(ranked: DataFrame, present: DataFrame, folder: str) -> DataFrame:
    """``query_id, rank, image_path`` of image passages whose file is ``present`` (``path``), at its own path or by its name in ``folder``."""
    images = ranked.filter((F.col("type") == "image") & (F.coalesce("image_path", F.lit("")) != "")).select("query_id", "rank", "image_path")
    other = F.concat(F.lit(folder.rstrip("/") + "/"), file_name(F.col("image_path")))
    either = images.withColumn("path", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("image_path").alias("p")), F.struct(F.lit(1).alias("n"), other.alias("p")))))
    found = either.select("query_id", "rank", "path.n", F.col("path.p").alias("path")).join(present.select("path").distinct(), "path", "left_semi")
    return found.groupBy("query_id", "rank").agg(F.min_by("path", "n").alias("image_path"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types are inferred. Missing files raise."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``ord, filename, sha256, url`` of a manifest's documents."""
    docs = spark.read.schema("docs array<struct<filename:string,sha256:string,url:string>>").json(path, multiLine=True)
    return docs.select(F.posexplode("docs").alias("ord", "d")).select("ord", "d.*")


REGISTRY = "sha256 string, source string"
LOG = "timestamp string, vectors_added bigint, vectors_deleted bigint, pdfs_downloaded bigint, duration_s double, errors array<string>"


def save_registry(hashes: DataFrame, path: str) -> None:
    """Writes ``sha256, source`` to ``path``, a new one for each version, so that what is read meanwhile is not overwritten."""
    hashes.select("sha256", "source").write.json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry that ``save_registry`` wrote."""
    return spark.read.schema(REGISTRY).json(path)


def without_file(hashes: DataFrame, name: str) -> DataFrame:
    """A registry less a file."""
    return hashes.filter(~F.col("source").eqNullSafe(F.lit(name)))


def append_log(spark: SparkSession, path: str, result: dict) -> None:
    """Adds a run's result, with the time in UTC, to the log."""
    row = {"timestamp": datetime.now(UTC).isoformat(), "vectors_added": 0, "vectors_deleted": 0, "pdfs_downloaded": 0, "duration_s": 0.0, "errors": []} | result
    names = [c.split()[0] for c in LOG.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], LOG).coalesce(1).write.mode("append").json(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, source`` of a registry that maps one to the other."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("sha256", "source"))
