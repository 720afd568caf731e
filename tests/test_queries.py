"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir_module}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    from tests.conftest import DATA

    return str(DATA)


def _rows(columns, rows):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6))
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, sf_dir_module, name):
    df = QUERIES[name](spark, sf_dir_module)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, found.fetchall())


def test_every_query_is_known():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["diversity_select", "rerank_overlap", "rag_prompts", "chunk_recursive", "chunk_fixed", "chunk_hierarchical", "embed_hash"])
def test_runs(spark, sf_dir_module, name):
    assert QUERIES[name](spark, sf_dir_module).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
