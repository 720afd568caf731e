"""Parsed tables: cleaning, profile, markdown and JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import markdown, strip

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def clean(df: DataFrame) -> DataFrame:
    """Without rows and columns that hold nothing; texts stripped, nulls kept."""
    rows = df.dropna("all")
    held = rows.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return rows.select(*((strip(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")) for (c, t), n in zip(df.dtypes, held) if n))


def profile(df: DataFrame) -> DataFrame:
    """``column, n_rows, n_null, low, high, mean``: the last three of numeric columns, 4 places. One pass over the table."""
    number = {c: t in _NUMBERS or t.startswith("decimal") for c, t in df.dtypes}
    value = lambda f, c: F.round(f(F.col(f"`{c}`").cast("double")), 4) if number[c] else F.lit(None).cast("double")
    each = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null"), value(F.min, c).alias("low"), value(F.max, c).alias("high"), value(F.avg, c).alias("mean")) for c in df.columns]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def to_markdown(df: DataFrame, order: str, rows: int = 50) -> DataFrame:
    """One row ``markdown``: the header and the first ``rows`` rows in ``order``."""
    cells = F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))
    top = df.orderBy(order).limit(rows).select(F.struct(F.col(order).alias("o"), cells.alias("cells")).alias("x"))
    body = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cells"])
    return top.agg(markdown(F.concat(F.array(F.array(*map(F.lit, df.columns))), body)).alias("markdown"))
