"""Tables in HTML as arrays of cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def tables_in(html: str | None) -> list[list[list[str]]]:
    """All tables of a page, as rows of cells; empty ones keep their place."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return parser.tables


def tables(pages: DataFrame, source: str, html: str) -> DataFrame:
    """``source`` (with the table's number, counted with empty ones), ``rows`` of every table that has a row."""

    @F.pandas_udf("array<array<array<string>>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(tables_in)

    each = pages.select(F.col(source).alias("s"), F.posexplode(found(F.col(html))).alias("i", "rows"))
    return each.filter(F.size("rows") > 0).select(F.concat(F.col("s"), F.lit("::table_"), F.col("i").cast("string")).alias("source"), "rows")
