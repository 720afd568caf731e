"""Spelling variants against all pairs by the textbook distance."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(_AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdé") for _ in range(draw.randint(6, 9))) for _ in range(25)] + ["prefix" + "".join(draw.choice("ab") for _ in range(3)) for _ in range(8)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÉÉÉÉÉÉ", "straße", "x×÷xÿÀy"]
    words = list(base)
    for w in base:
        for _ in range(3):
            k = draw.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + draw.choice("abcdé") + w[k:], w[:k] + draw.choice("abcdé") + w[k + 1 :]]
    weight = [draw.choice([1, 1, 3, 10, 60]) for _ in words]
    rows = []
    for i in range(150):
        picked = draw.choices(words, weight, k=120)
        rows.append((i, "".join((w.upper() if draw.random() < 0.1 else w.capitalize() if draw.random() < 0.2 else w) + draw.choice([" ", "\n", ", ", "-", "日", "1", "Ā"]) for w in picked)))
    return rows + [(150, None), (151, ""), (None, "aaaaaa " * 7), (3, "again repeated " * 9), (3, "again repeated " * 9), (152, ("q" * 3000 + " ") * 6 + ("q" * 2999 + "z ") * 40)]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id bigint, text string, word string, n int").repartition(4)


def test_counts(table, texts):
    assert {r.word: r.n for r in spelling.vocabulary(table).collect()} == brute_words(texts)


@pytest.mark.parametrize("shard, hot, alike, most_ends", [(spelling.SHARD, spelling.HOT, spelling.ALIKE, 1 << 17), (5, 20, 3, 1 << 17), (40, 0, 99, 1 << 17), (5, 9, 99, 0), (10, 999, 999, 0)])
def test_variants(table, texts, shard, hot, alike, most_ends):
    short = [(i, t) for i, t in texts if i != 152]
    expected = brute(short) + [("q" * 2999 + "z", None, "q" * 2999 + "z", 40, 1, None), ("q" * 3000, "q" * 2999 + "z", "q" * 2999 + "z", 6, 1, 40)]
    got = sorted((tuple(r) for r in spelling.variants(table, shard, hot, alike, most_ends).collect()), key=lambda r: r[0])
    assert got == sorted(expected, key=lambda r: r[0])
    assert sum(r[1] is not None for r in got) > 10 and any(r[1] != r[2] and r[1] for r in got)


def test_chain(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(30)] + [("a", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert set(got.values()) == {"w30"} and len(got) == 31


def test_edges(spark, empty, nulls):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(nulls).count() == 0


def test_distance():
    draw = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(3, 7))) for _ in "xy")
        assert spelling.one_apart(a, b) == (distance(a, b) == 1)
        # One kind of end tells of a pair, and only one.
        if distance(a, b) == 1:
            assert spelling.meets(a, b, 0) + spelling.meets(a, b, 1) == 1


def test_scan_finds_all():
    draw = random.Random(9)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(6, 9))) for _ in range(400)})
    ns = [draw.randrange(5, 50) for _ in words]
    both = [(w, n, k) for w, n in zip(words, ns) for k in (0, 1)]
    found = dict.fromkeys(words, 0)
    for w, k, _, _ in spelling.scanned(*map(list, zip(*both))):
        found[w] += k
    assert found == {w: sum(distance(w, v) == 1 for v in words) for w in words}


def test_crc():
    draw = random.Random(6)
    spans = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 1, 5, 64, 65, 300]))) for _ in range(200)]
    data, size = np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans])
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(len(spans))], np.uint32)
    got = spelling._crcs(before, data, np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + s) for k, s in enumerate(spans)]
