"""Chunk recipes: cutting, verification, and groups against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from lodestone.llm import exact_dedup
from pyspark.sql import functions as F

BLANK = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    out = []
    for plain, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(plain.encode()).hexdigest()) for _, i in members]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id bigint, text string, keep_id string, group_size int, kept boolean").repartition(5)


@pytest.fixture(scope="module")
def more(rows):
    """Documents with copies that differ in blanks, many equal ones, and long ones that differ at one place."""
    draw = random.Random(11)
    out = list(rows)
    for i, t in rows[::3]:
        if t:
            out.append((1000 + i, "".join(c + draw.choice(["", "", " ", "\n", "\t"]) for c in t)))
    long_ = "".join(draw.choice("abcdefghiksow .,日。é😀") for _ in range(30_000))
    out += [(2000 + k, long_) for k in range(40)] + [(3000 + k, long_[: 500 * k] + "!" + long_[500 * k :]) for k in range(20)] + [(4000, " " + long_ + "\x0b"), (4001, long_ + " ")]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("most_keys", [exact_dedup.MOST_KEYS, 0])
def test_groups(spark, more, most_keys):
    got = sorted(tuple(r) for r in exact_dedup.groups(table(spark, more), most_keys=most_keys).collect())
    assert got == brute(more)


def test_shared_identifiers_are_found_and_made_anew(spark, more):
    tried = []

    def weak(salt, value):
        tried.append(salt)
        if salt == 0:  # one identifier for many chunks
            return F.array(F.xxhash64(value) % 7, F.lit(0).cast("bigint"))
        return exact_dedup.hashed(salt, value)

    got = sorted(tuple(r) for r in exact_dedup.groups(table(spark, more), hash_=weak).collect())
    assert got == brute(more) and max(tried) == 1


@pytest.mark.parametrize("least, most", [(exact_dedup.LEAST, exact_dedup.MOST), (4, 16), (1, 9)])
def test_chunks_are_the_text_and_meet_again(spark, least, most):
    draw = random.Random(1)
    text = "".join(draw.choice("acegikmoqswy.é日。😀") for _ in range(20_000))
    df = spark.createDataFrame([(text,), ("zz" + text,), ("a",), ("",), ("x" * 5000,)], "t string").coalesce(1)
    a, b, one, none, same = (r.c for r in df.select(exact_dedup.chunks(F.col("t"), least, most).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == "zz" + text and one == ["a"] and none == [] and "".join(same) == "x" * 5000
    assert all(least < len(c) <= most for c in a[:-1]) and max(map(len, same)) == most
    assert len(set(b) & set(a)) > 0.9 * len(set(a))


def test_edges(spark, nulls, empty):
    assert exact_dedup.groups(empty).count() == 0
    got = exact_dedup.groups(nulls).collect()
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in got) == [("7", 1, True), ("7", 2, False), ("7", 2, True), ("None", 2, False), ("None", 2, True)]
    rows = [(None, "a b"), (5, "ab "), (9, "a  "), (9, " a "), (-(2**63), "q"), (2**63 - 1, "q")]
    found = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups(table(spark, rows)).collect()}
    assert found == {(None, 5, 2), (5, 5, 2), (9, 9, 2), (-(2**63), -(2**63), 2), (2**63 - 1, -(2**63), 2)}


def test_one_text_for_all(spark):
    rows = [(i, "the same text " * 3000) for i in range(300)]
    assert {(r.keep_id, r.group_size) for r in exact_dedup.groups(table(spark, rows)).collect()} == {(0, 300)}
    assert [r.doc_id for r in exact_dedup.keep_one(table(spark, rows)).collect()] == [0]


def test_no_python_on_the_way(docs):
    plan = exact_dedup._cut(docs, 0, exact_dedup.hashed, 384, 2048)._jdf.queryExecution().toString() + exact_dedup.groups(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
