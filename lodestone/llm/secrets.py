"""Secret scans with structural confirmation (list item 10).

Base patterns find assignments, access keys and long hex runs. Besides, runs of base64 or hex (over line breaks too), from wherever
in them a key may begin to the end that its outer length tells, are decoded and parsed before they are reported: as a private key, whose nested lengths must add up to the byte, or as a signed
token, whose header and claims must be JSON objects that name an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays

_MAGIC = b"openssh-key-v1\0"
#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "key", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs that are long enough are the matches of the open-ended patterns that are not dropped: both take a run from its start.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run, and those of the lines after it (breaks may be escaped) that hold nothing before theirs.
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*[A-Za-z0-9+/_-]+)*={0,2}")
_PIECE = re.compile(r"(?:\A|(?<=\n)[\x20\t>]*|(?:\\r)?\\n[\x20\t>]*)([A-Za-z0-9+/_-]+)")
# Only what begins like a key is worth parsing: a DER sequence, or the OpenSSH magic.
_BASE64_START = re.compile(r"(?=M[B-I]|b3BlbnNzaC1rZXktdjEA)")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{80,}")
_HEX_START = re.compile(r"(?=30)")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----")
#: Headers, and then what may be a body, each read once.
_INSIDE = re.compile(r"((?:\s|\\[nr])*+(?:[A-Za-z-]++:[^\n\\]*+(?:\n|\\n)(?:[\x20\t\r]|\\r)*+)*+)([A-Za-z0-9+/=\s\\]*+)")
#: Whole segments only are tried, each from where its run begins, so a text is read once whatever it holds.
_SEGMENT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,}+)\.(?=([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*+))")
#: What nests in JSON, and what hides it.
_NESTING = re.compile(rb'["{}\[\]]')
#: Elements that a key's structures have at most, and keys in one OpenSSH file; real ones have ten and one.
_PARTS, _KEYS = 16, 64


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end (exclusive) and kind of the base patterns' matches."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _head(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and where the content starts and ends, of the DER element at ``at``; None if its length does not fit before ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= end else None


def der(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of content of the elements that ``data[at:end]`` is made of, or None if lengths do not add up or there are too many.

    Only heads are read, so that a claim of any length costs nothing.
    """
    out, end = [], len(data) if end is None else end
    while at < end:
        found = _head(data, at, end)
        if found is None or len(out) == _PARTS:
            return None
        out.append(found)
        at = found[2]
    return out


def is_key(data: bytes, at: int = 0, end: int | None = None) -> bool:
    """Whether the bytes are a private key: PKCS 1, SEC 1, DSA, PKCS 8 (plain or encrypted) or OpenSSH."""
    end = len(data) if end is None else end
    if data.startswith(_MAGIC, at, end):
        return _openssh_length(data, at, end) == end - at
    outer = _head(data, at, end)
    if outer is None or outer[0] != 0x30 or outer[2] != end:
        return False
    parts = der(data, outer[1], end)
    if not parts:
        return False
    tags, size = [t for t, _, _ in parts], lambda i: parts[i][2] - parts[i][1]
    if tags[0] == 0x02 and size(0) == 1 and data[parts[0][1]] <= 1:
        if tags[:3] == [0x02, 0x30, 0x04]:
            named = der(data, *parts[1][1:])
            return bool(named) and named[0][0] == 0x06
        if tags[:2] == [0x02, 0x04]:
            return data[parts[0][1]] == 1 and size(1) >= 16 and all(t in (0xA0, 0xA1) and der(data, a, b) is not None and a < b for t, a, b in parts[2:])
        return set(tags) == {0x02} and len(tags) in (6, 9)
    if tags == [0x30, 0x04]:
        named = der(data, *parts[0][1:])
        return bool(named) and named[0][0] == 0x06 and size(1) >= 16
    return False


def _openssh_length(data: bytes, at: int, end: int) -> int:
    """How many bytes the OpenSSH key at ``at`` takes; 0 if its fields do not fit before ``end``.

    Cipher, derivation, its options, the number of keys, those, and the private part.
    """
    start, at, left, fields = at, at + len(_MAGIC), 3, 0
    while left:
        if at + 4 > end:
            return 0
        at, left, fields = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1, fields + 1
        if fields == 3:
            keys = int.from_bytes(data[at : at + 4], "big")
            if at + 4 > end or not 1 <= keys <= _KEYS:
                return 0
            left, at = keys + 1, at + 4
    return at - start if at <= end else 0


def _decoded(run: str) -> bytes | None:
    run = re.sub(r"\s|\\[nr]", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object_start(data: bytes) -> int:
    """Where the JSON object starts that ends with ``data``, if there is one; else -1. Only one bracket can match the last one."""
    end, depth = len(data.rstrip()), 0
    if not data[:end].endswith(b"}"):
        return -1
    marks = [m.start() for m in _NESTING.finditer(data, 0, end)]
    while marks:
        at = marks.pop()
        c = data[at]
        if c == 0x22:  # a string's end: back to the quote that no backslash escapes
            while marks:
                at = marks.pop()
                slashes = at
                while data[at] == 0x22 and slashes and data[slashes - 1] == 0x5C:
                    slashes -= 1
                if data[at] == 0x22 and (at - slashes) % 2 == 0:
                    break
        elif c in b"}]":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return at if c == 0x7B else -1
    return -1


def _tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of signed tokens; a header may follow other characters of its run.

    A run is decoded from each of the four places where a byte can begin, and in each only one header can end with it.
    """
    found, to = [], 0
    for m in _SEGMENT.finditer(text):
        low, starts = max(m.start(1), to), []
        for at in range(low, min(low + 4, m.end(1))):
            data = _decoded(text[at : m.end(1)])
            s = _object_start(data) if data else -1
            if s >= 0 and s % 3 == 0:
                starts.append(at + s // 3 * 4)
        for s in sorted(starts):
            if is_token(f"{text[s : m.end(1)]}.{m[2]}.{m[3]}"):
                to = m.end(1) + 2 + len(m[2]) + len(m[3])
                found.append((s, to))
                break
    return found


def is_token(run: str) -> bool:
    """Whether the run is a signed token: a JSON header that names an algorithm, JSON claims, and a signature if one is due."""
    header, claims, signature = run.split(".")
    try:
        head, body = (json.loads(_decoded(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return head["alg"].lower() == "none" or (len(signature) >= 16 and _decoded(signature) is not None)


def _length(data: bytes, at: int) -> int:
    """How many bytes the DER sequence at ``at`` takes, if what stands first in it can be a key's; else 0."""
    head = data[at : at + 9]
    if len(head) < 8 or head[0] != 0x30:
        return 0
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4 or head[1] == 0x80:
        return 0
    inner = head[2 + k :]
    if not inner.startswith((b"\x30", b"\x02\x01\x00"[: len(inner)], b"\x02\x01\x01"[: len(inner)])):
        return 0
    return 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def _keys(run: str) -> list[tuple[int, int]]:
    """Start and end of private keys in a run of base64 or hex; none begins inside another. The run is decoded once for each place where a byte can begin."""
    found, to, decoded = [], 0, {}
    for m in _BASE64_START.finditer(run):
        a = m.start()
        if a < to:
            continue
        if a % 4 not in decoded:
            decoded[a % 4] = _decoded(run[a % 4 : len(run) - ((len(run) - a) % 4 == 1)]) or b""
        data, at = decoded[a % 4], a // 4 * 3
        n = _openssh_length(data, at, len(data)) if run[a] == "b" else _length(data, at)
        b = a - (-n * 8 // 6)
        if n and b <= len(run) and at + n <= len(data) and is_key(data, at, at + n):
            found.append((a, b))
            to = b
    for h in _HEX_RUN.finditer(run):
        to, halves = 0, {}
        for m in _HEX_START.finditer(h[0]):
            a = m.start()
            if a < to:
                continue
            if a % 2 not in halves:
                halves[a % 2] = bytes.fromhex(h[0][a % 2 : len(h[0]) - (len(h[0]) - a) % 2])
            data, at = halves[a % 2], a // 2
            n = _length(data, at)
            if n and at + n <= len(data) and is_key(data, at, at + n):
                to = a + 2 * n
                found.append((h.start() + a, h.start() + to))
    return found


def _armoured(text: str) -> list[tuple[int, int]]:
    """Start and end of keys between the lines that say so. What follows several beginnings is read once: it ends at the same place for all."""
    found, done, body, end, data = [], 0, 0, 0, None
    for m in _BEGIN.finditer(text):
        if m.start() < done:
            continue
        if m.end() > body or not body:
            inside = _INSIDE.match(text, m.end())
            body, end, data = inside.end(1), inside.end(), None
        close = f"-----END {m[1]}PRIVATE KEY-----"
        if text.startswith(close, end):
            data = (_decoded(text[body:end]) or b"") if data is None else data
            if _in_armour(text[m.end() : body], data):
                done = end + len(close)
                found.append((m.start(), done))
    return found


def _in_armour(headers: str, data: bytes) -> bool:
    """A key, or, where headers say that it is encrypted, whole blocks of a cipher's."""
    return is_key(data) or ("ENCRYPTED" in headers and len(data) >= 64 and len(data) % 8 == 0)


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of runs that decode to a private key or a signed token, in time in proportion to the text."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [(a, b, "key") for a, b in _armoured(text)]
    inside = list(found)
    for m in _ENCODED.finditer(text):
        pieces = [(x.start(1), x[1]) for x in _PIECE.finditer(m[0])]
        joined = "".join(x for _, x in pieces)
        starts = [0]
        for _, x in pieces:
            starts.append(starts[-1] + len(x))

        def place(i: int) -> int:
            k = bisect.bisect_right(starts, i) - 1
            return m.start() + pieces[k][0] + i - starts[k]

        for a, b in sorted(_keys(joined)):
            start, end = place(a), place(b - 1) + 1
            if b == len(joined):
                end += len(m[0]) - len(m[0].rstrip("="))
            if not any(x <= start < y for x, y, _ in inside):
                found.append((start, end, "key"))
    return found + [(a, b, "token") for a, b in _tokens(text)]


def written(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


@arrays.tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch, _, _ in arrays.passes(batches, "text"):
        counts, hashes, spans, lists = [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            every = base + confirmed_spans(text)
            kinds = [s[2] for s in base]
            counts.append([kinds.count(k) for k in KINDS[:3]])
            hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
            lists.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(every)])
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(hashes), pa.array(spans), pa.array(lists, spans_of)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found`` (kind, start, end in code points).

    Null and empty texts have no span. Spans of different kinds may overlap; each kind's own do not. Null ids and repeated rows
    are scanned like others. Columns besides ``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
    """
    arrays.session_limits(docs)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>")
