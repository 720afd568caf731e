"""Images made ready for recognition: grey, and larger if small; recognisers are plugins."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least width and height, and by how much smaller images grow at least.
WIDTH, HEIGHT, TIMES = 300, 100, 2.0
#: Neighbours on each side that a new pixel is made of.
_LOBES = 3
#: A function that loads a recogniser (once in each task), which takes grey pixels and gives a text.
_RECOGNISERS: dict[str, Callable[[], Callable[[np.ndarray], str]]] = {}


def register_recogniser(name: str, load: Callable[[], Callable[[np.ndarray], str]]) -> None:
    _RECOGNISERS[name] = load


def decoded(content: bytes) -> np.ndarray:
    """Height x width x channels of a PNG of 8 bits a sample, not interlaced; others raise ``ValueError``."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a PNG of this kind is not read")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    rows = raw[: height * (1 + width * channels)].reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y - 1] if y else np.zeros(width * channels, np.uint8)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).reshape(-1)
        else:
            _unfiltered(int(kind), line.tolist(), up.tolist(), channels, out[y])
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if head[3] == 3 and palette is not None else pixels


def _unfiltered(kind: int, line: list[int], up: list[int], channels: int, out: np.ndarray) -> None:
    """Filters that need the pixel before: the mean, and the nearest of three."""
    done = [0] * len(line)
    for i, x in enumerate(line):
        a, b, c = (done[i - channels], up[i], up[i - channels]) if i >= channels else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        done[i] = (x + guess) & 0xFF
    out[:] = done


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue in whole numbers; opacity is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    r, g, b = (pixels[:, :, i].astype(np.uint32) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16).astype(np.uint8)


def _weights(old: int, new: int) -> np.ndarray:
    """new x old weights of windowed sinc resampling, each row of sum 1."""
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    width = max(1.0, old / new)
    x = (np.arange(old)[None, :] - centre[:, None]) / width
    w = np.where(np.abs(x) < _LOBES, np.sinc(x) * np.sinc(x / _LOBES), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def enlarged(pixels: np.ndarray) -> np.ndarray:
    """Grey pixels, resampled to at least ``WIDTH`` by ``HEIGHT`` and ``TIMES`` the size, if they are smaller than that."""
    height, width = pixels.shape
    if width >= WIDTH and height >= HEIGHT:
        return pixels
    times = max(WIDTH / width, HEIGHT / height, TIMES)
    out = _weights(height, int(height * times)) @ pixels.astype(float) @ _weights(width, int(width * times)).T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def prepared(images: DataFrame) -> DataFrame:
    """``image_path, width, height, pixels`` (grey, a byte each, by rows) of ``image_path, content``, and ``error`` where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("image_path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    p = enlarged(grey(decoded(content or b"")))
                    row = [path, p.shape[1], p.shape[0], p.tobytes(), None]
                except Exception as e:  # noqa: BLE001  a bad image is data
                    row = [path, None, None, None, f"{type(e).__name__}: {e}"]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], ["image_path", "width", "height", "pixels", "error"])

    return images.select("image_path", "content").mapInArrow(run, "image_path string, width int, height int, pixels binary, error string")


def texts(ready: DataFrame, recogniser: str) -> DataFrame:
    """``image_path, text`` of prepared images, stripped; empty where an image or its recognition fails."""
    if recogniser not in _RECOGNISERS:
        raise LookupError(f"no recogniser {recogniser!r}; register_recogniser() takes one")
    load = _RECOGNISERS[recogniser]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = load()
        for batch in batches:
            said = []
            for w, h, p in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels"))):
                try:
                    said.append(read(np.frombuffer(p, np.uint8).reshape(h, w)).strip())
                except Exception:  # noqa: BLE001  as an image without text
                    said.append("")
            yield pa.RecordBatch.from_arrays([batch.column("image_path"), pa.array(said, pa.string())], ["image_path", "text"])

    return ready.select("image_path", "width", "height", "pixels").mapInArrow(run, "image_path string, text string").select("image_path", F.coalesce("text", F.lit("")).alias("text"))
