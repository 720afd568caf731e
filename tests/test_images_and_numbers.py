"""Images against plain loops, and rounding against Python's own."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from lodestone.functions import numbers, text, vectors
from lodestone.operators import replicate
from lodestone.plans import ingest
from lodestone.schema import canonical
from lodestone.sources import images
from pyspark.sql import functions as F

draw = random.Random(2)


def png(pixels, kind, filters=0, palette=None):
    """A PNG of an array, by a plain loop over its bytes."""
    height, width, channels = pixels.shape
    out, before = b"", [0] * (width * channels)
    for y in range(height):
        line = pixels[y].reshape(-1).tolist()
        f = filters if isinstance(filters, int) else filters[y % len(filters)]
        coded = []
        for i, x in enumerate(line):
            a, b, c = (line[i - channels] if i >= channels else 0), before[i], (before[i - channels] if i >= channels else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded.append((x - (0, a, b, (a + b) // 2, near)[f]) % 256)
        out, before = out + bytes([f, *coded]), line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(out)
    extra = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", data[:40]) + chunk(b"IDAT", data[40:]) + chunk(b"IEND", b"")


def noise(height, width, channels):
    return np.array([draw.randrange(256) for _ in range(height * width * channels)], np.uint8).reshape(height, width, channels)


@pytest.mark.parametrize("kind, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_decoding(kind, channels):
    pixels = noise(11, 7, channels)
    for filters in (0, 1, 2, 3, 4, [0, 1, 2, 3, 4]):
        assert (images.decoded(png(pixels, kind, filters)) == pixels).all()
    palette = noise(1, 256, 3)[0]
    indexes = noise(5, 5, 1)
    assert (images.decoded(png(indexes, 3, palette=palette)) == palette[indexes[:, :, 0]]).all()


def plain(pixels):
    """Grey and larger, pixel by pixel."""
    height, width, channels = pixels.shape
    g = [[(19595 * int(p[0]) + 38470 * int(p[1]) + 7471 * int(p[2]) + 32768) >> 16 if channels > 2 else int(p[0]) for p in row] for row in pixels]
    if width >= 300 and height >= 100:
        return g
    times = max(300 / width, 100 / height, 2.0)
    kernel = lambda x: 0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2

    def stretched(line, new):
        out = []
        for i in range(new):
            at = (i + 0.5) * len(line) / new - 0.5
            w = [kernel(j - at) for j in range(len(line))]
            out.append(sum(a * b for a, b in zip(w, line)) / sum(w))
        return out

    wide = [stretched(row, int(width * times)) for row in g]
    tall = list(zip(*(stretched(col, int(height * times)) for col in zip(*wide))))
    return [[min(255, max(0, math.floor(v + 0.5))) for v in row] for row in tall]


@pytest.mark.parametrize("height, width, channels", [(20, 30, 3), (110, 12, 1), (100, 300, 3), (3, 299, 4)])
def test_grey_and_size(height, width, channels):
    pixels = noise(height, width, channels)
    got, expected = images.enlarged(images.grey(pixels)).astype(int), np.array(plain(pixels))
    assert got.shape == expected.shape and np.abs(got - expected).max() <= 1 and (got != expected).mean() < 0.001


def test_prepared_and_recognised(spark):
    one = noise(40, 60, 3)
    table = spark.createDataFrame([("a.png", png(one, 2)), ("b.png", b"no"), ("c.png", None), ("d.png", png(one, 2)[:60])], "image_path string, content binary").repartition(2)
    ready = images.prepared(table)
    rows = {r.image_path: r for r in ready.collect()}
    assert (rows["a.png"].width, rows["a.png"].height) == (300, 200) and rows["a.png"].pixels == images.enlarged(images.grey(one)).tobytes()
    assert all(rows[k].error and rows[k].pixels is None for k in ("b.png", "c.png", "d.png"))
    images.register_recogniser("size", lambda: lambda p: f" {p.shape[1]}x{p.shape[0]}\n")
    assert {r.image_path: r.text for r in images.texts(ready, "size").collect()} == {"a.png": "300x200", "b.png": "", "c.png": "", "d.png": ""}
    with pytest.raises(LookupError):
        images.texts(ready, "none")


def test_rounding_by_the_binary_value(spark):
    values = [k / 10 ** p * s for p in (3, 5, 7) for k in range(1, 400) for s in (1, -1)] + [k / 2**n for n in range(1, 18) for k in (1, 3, 5, 7, 1001)] + [draw.uniform(-9, 9) for _ in range(500)] + [2.675, 1.005, 0.5, 1.5, 2.5, 0.0, -0.0, 1e12 + 0.5, 1e-9, 123456.78125, 1000000.125, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for places in (0, 2, 4, 6):
        for r in df.select("i", "x", numbers.round_binary(F.col("x"), places).alias("y")).collect():
            expected = None if r.x is None else r.x if not math.isfinite(r.x) else round(r.x, places)
            assert r.y == expected or (expected is not None and math.isnan(expected) and math.isnan(r.y)), (r.x, places, r.y)


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.short_section(F.lit("x" * 23))) == "x" * 22 + "…" and one(text.short_section(F.lit("x" * 22))) == "x" * 22
    assert one(vectors.rounded_box(F.array(*(F.lit(v) for v in (1.005, 2.675, 0.125, 10.0))))) == [round(v, 2) for v in (1.005, 2.675, 0.125, 10.0)]
    assert one(vectors.rounded_box(F.array(F.lit(1.0)))) is None
    assert canonical(spark.createDataFrame([(0.03125,)], "score double")).first().score == 0.0312
    names, points = (spark.createDataFrame([(x,) for x in xs], "source string") for xs in (["a", "b", "z"], ["a", "a", "b"]))
    known, unknown = replicate.membership(names, points)
    assert sorted(r[0] for r in known.collect()) == ["a", "b"] and [r[0] for r in unknown.collect()] == ["z"]
    for stores, online in (({"cloud": None}, True), ({}, False)):
        with pytest.raises(ConnectionError):
            ingest.delete_file(stores, "a.pdf", online)
