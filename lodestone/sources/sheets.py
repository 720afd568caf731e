"""Spreadsheets as rows of cells: a reader of zipped workbook XML that streams rows, and the choice of a reader by a file's suffix."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import file_name, markdown
from lodestone.sources import files

#: Rows that a task hands on at a time.
ROWS = 2000
ROW = "source string, sheet string, ord bigint, cells array<string>, error string"
#: Number formats that are dates or times without saying so.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.')


def _name(element: ElementTree.Element) -> str:
    """A tag without its name space: files of either edition of the format read alike."""
    return element.tag.rpartition("}")[2]


def _parts(book: zipfile.ZipFile, path: str) -> dict[str, str]:
    """What a part's relations call other parts."""
    folder, base = posixpath.split(path)
    try:
        root = ElementTree.fromstring(book.read(f"{folder}/_rels/{base}.rels"))
    except KeyError:
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in root}


def _text(element: ElementTree.Element) -> str:
    """The runs of a string; what tells its reading aloud is left out."""
    return "".join(t.text or "" for part in element if _name(part) != "rPh" for t in part.iter() if _name(t) == "t")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if _name(e) == "si":
            found.append(_text(e))
            e.clear()
    return found


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether numbers in it are dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): bool(re.search("[ymdhs]", _QUOTED.sub("", f.get("formatCode", "")).lower())) for f in root.iter() if _name(f) == "numFmt"}
    styles = next((e for e in root if _name(e) == "cellXfs"), ())
    return [own.get(k := int(x.get("numFmtId", 0)), k in _DATE_FORMATS) for x in styles]


def _date(days: float, from_1904: bool) -> str:
    """A day number as ISO text; the day that never was in 1900 is stepped over."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    at = start + timedelta(seconds=round(days * 86_400))
    return at.date().isoformat() if days == int(days) else at.time().isoformat() if days < 1 and not from_1904 else at.isoformat(" ")


def _column(place: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", place or "")
    if not letters:
        return after
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str], dated: list[bool], from_1904: bool) -> str | None:
    kind, parts = cell.get("t", "n"), {_name(e): e for e in cell}
    if kind == "inlineStr":
        return _text(parts["is"]) if "is" in parts else None
    text = parts["v"].text if "v" in parts else None
    if text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    if kind == "n":
        style = int(cell.get("s", 0))
        if style < len(dated) and dated[style]:
            return _date(float(text), from_1904)
        return text[:-2] if text.endswith(".0") else text
    return text


def workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number from 0, and cells of each row that has any; a row is as long as its last cell is far to the right."""
    book = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    parts, strings, dated = _parts(book, "xl/workbook.xml"), _strings(book), _dated(book)
    from_1904 = any(_name(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    for sheet in (e for e in root.iter() if _name(e) == "sheet"):
        path = parts.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
        if not path.startswith("xl/worksheets/"):
            continue  # a chart is no table
        n = -1
        for _, e in ElementTree.iterparse(book.open(path)):
            if _name(e) != "row":
                continue
            n, cells = int(e.get("r", n + 2)) - 1, []
            for c in (c for c in e if _name(c) == "c"):
                at = _column(c.get("r"), len(cells))
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(c, strings, dated, from_1904)
            if any(x is not None and x.strip() for x in cells):
                yield sheet.get("name"), n, cells
            e.clear()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["source", "sheet", "ord", "cells", "error"])

    for one in batches:
        for source, content in zip(one.column("source").to_pylist(), one.column("content")):
            rows = []
            try:
                for sheet, n, cells in workbook(content.as_buffer().to_pybytes()):
                    rows.append((source, sheet, n, cells, None))
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows = []
            except Exception as e:  # noqa: BLE001  a bad file is data
                rows.append((source, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield batch(rows)


def spreadsheets(found: DataFrame, sheet: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``source`` (``file::sheet``), ``ord, cells`` of the rows of workbooks (``source, content``), and ``source, error`` of those that failed.

    Rows without a value are left out, and so are empty sheets. Numbers, dates (ISO) and truth values are text that Spark can cast; errors are
    null. A workbook that breaks off has the rows before that and an error. Both frames read the files; write what is used twice.
    """
    each = found.select("source", "content").mapInArrow(_read, ROW)
    rows = each.filter("error IS NULL")
    rows = rows if sheet is None else rows.filter(F.col("sheet") == F.lit(sheet))
    return rows.select(F.concat("source", F.lit("::"), "sheet").alias("source"), "ord", "cells"), each.filter("error IS NOT NULL").select("source", "error")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """``source, ord, cells`` of a table file or a folder of them, by suffix: ``.csv`` or ``.xlsx``; any other raises ``ValueError``."""
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, multiLine=True, escape='"')
        return raw.select(file_name(F.col("_metadata.file_path")).alias("source"), F.monotonically_increasing_id().alias("ord"), F.array(*raw.columns).alias("cells"))
    if path.lower().endswith(".xlsx"):
        return spreadsheets(files.binary_files(spark, path))[0]
    raise ValueError(f"no reader for {path}; there are .csv and .xlsx")


def table(rows: DataFrame, source: str) -> DataFrame:
    """One source's rows under the names of its first row, as strings: blank names get a number, and so do repeated ones."""
    own = rows.filter(F.col("source") == F.lit(source))
    first = own.orderBy("ord").limit(1).collect()
    names: list[str] = []
    for i, name in enumerate(first[0].cells if first else []):
        name = (name or "").strip() or f"Unnamed: {i}"
        names.append(name if name not in names else f"{name}.{sum(n == name or n.startswith(name + '.') for n in names)}")
    value = lambda i: F.try_element_at("cells", F.lit(i + 1))
    return own.filter(F.col("ord") > (first[0].ord if first else -1)).select(*(value(i).alias(n) for i, n in enumerate(names)))


def markdown_tables(rows: DataFrame, most: int = 50) -> DataFrame:
    """``source, markdown`` of each source's heading and first ``most`` rows."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("ord"))
    first = rows.withColumn("_n", number).filter(F.col("_n") <= most + 1)
    return first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_n", "cells"))).alias("r")).select("source", markdown(_cells(F.col("r"))).alias("markdown"))


def _cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["cells"])
