"""The fill-in-the-middle transformation against lists of units, and its way back."""

import hashlib
import random
import re

import pytest
from lodestone.llm import fill_middle as fim


def brute(doc_id, text, seed=7, rate=100, spm=50, width=None):
    pattern = r"[^\n]*\n|[^\n]+" if width is None else rf"[^\n]{{0,{width - 1}}}\n|[^\n]{{1,{width}}}"
    units = re.findall(pattern, text)
    h = [int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    assert "".join(units) == text
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", "\n", "\n\n\n", "a", "a\n", "\na", "a\nb\n\nc", "😀\nnaïve 日本\n", "x <P> y\nz", "<S>", "<M", "<P <S >\n", "a<\n<\n", "\r\n\x0b\x85  b\nc", "line\n" * 1000, "z" * 5000]


@pytest.mark.parametrize("rate, spm, width", [(100, 50, None), (60, 0, None), (100, 100, 1), (100, 50, 3), (100, 50, 7)])
def test_rows_and_way_back(spark, rate, spm, width):
    draw = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(100 + i, "".join(draw.choice("ab\n\n é😀<P>") for _ in range(draw.randrange(60)))) for i in range(200)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, form string, n int").repartition(3)
    out = fim.transform(df, rate=rate, spm=spm, width=width)
    got = {r.doc_id: tuple(r)[1:] for r in out.withColumn("back", fim.restored(out.output, out.form)).collect()}
    assert {i: x[:-1] for i, x in got.items()} == {i: brute(i, t, rate=rate, spm=spm, width=width) for i, t in rows}
    assert {i: x[-1] for i, x in got.items()} == dict(rows)
    assert {x[1] for x in got.values()} >= {"plain", "spm" if spm else "psm"}


def test_edges(spark, nulls, empty):
    assert fim.transform(empty).count() == 0
    got = fim.transform(nulls).collect()
    assert len(got) == 5
    assert sum(r.form == "plain" and r.output == "" and r.n == 0 for r in got) == 2
    same = [tuple(r) for r in got if r.doc_id == 7 and "a b c d" in r.output.replace("<P>", "").replace("<S>", "").replace("<M>", "")]
    assert len(same) == 2 and same[0] == same[1]


def test_own_sentinels(spark):
    own = ("[[pre]]", "[[suf]]", "[[mid]]")
    df = spark.createDataFrame([(i, f"a {i}\nb <P> c\n{i}") for i in range(40)], "doc_id bigint, text string")
    out = fim.transform(df, sentinels=own, seed=1)
    got = out.select("doc_id", "form", fim.restored(out.output, out.form, own).alias("back")).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == f"a {r.doc_id}\nb <P> c\n{r.doc_id}" for r in got)


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("<P>x", "<P>", "<M>"), ("\n", "<S>", "<M>"), ("<P>", "<S>")])
def test_sentinels_that_could_not_be_taken_apart(bad):
    with pytest.raises(ValueError):
        fim.check_sentinels(bad)


def test_long_text(spark):
    text = ("word " * 20 + "\n") * 40_000 + "end"
    out = fim.transform(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    row = out.withColumn("back", fim.restored(out.output, out.form)).first()
    assert row.back == text and row.n == 40_001 and row.form != "plain"
