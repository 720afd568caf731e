"""Line and substring dedup, fingerprints and near-dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from lodestone.llm import arrays, components, line_dedup, merkle, simhash, substring_dedup, windows
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, width=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_substring(docs, rows):
    expected = brute_substring(rows)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == expected
    assert sum(r.n_removed for r in got) > 0
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_edges(nulls, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    got = substring_dedup.remove_repeats(nulls).collect()
    assert len(got) == 5 and all(r.n_removed == 0 for r in got)


def test_factors():
    at = np.array([0, 1, 2, 9])
    assert substring_dedup.spans(at, 3) == [(0, 5), (9, 12)]
    assert substring_dedup.spans(np.zeros(0, int), 3) == []
    one = np.zeros(4, np.int64)
    assert substring_dedup.factors(at, one, one, np.array([4, 5, 6, 7]), 3) == [(0, 5, 0, 4), (9, 12, 0, 7)]
    assert substring_dedup.factors(at, np.array([1, 2, 2, 2]), one, np.array([4, 5, 6, 7]), 3) == [(0, 3, 1, 4), (1, 5, 2, 5), (9, 12, 2, 7)]
    assert substring_dedup.factors(at[:0], one[:0], one[:0], one[:0], 3) == []


def test_factors_stand_in_their_sources(docs, rows):
    words, n = {i: WORD.findall(t or "") for i, t in rows}, 0
    for r in substring_dedup.remove_repeats(docs).collect():
        for f in r.factors:
            assert f.source < r.doc_id and f.end - f.start >= 13
            assert words[r.doc_id][f.start : f.end] == words[f.source][f.at : f.at + f.end - f.start]
            n += f.end - f.start > 13
        assert {k for s in r.spans for k in range(s.start, s.end)} == {k for f in r.factors for k in range(f.start, f.end)}
    assert n > 0


def brute_lines(rows, width=3):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        solid = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(solid) - width + 1):
            key = tuple(lines[j] for j in solid[k : k + width])
            if key in seen:
                gone.update(solid[k : k + width])
            seen.add(key)
        out[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_lines(docs, rows):
    got = line_dedup.remove_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == brute_lines(rows)


def test_lines_edges(nulls, empty):
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    assert line_dedup.remove_repeated_lines(nulls).filter("n_removed = 0").count() == 5


def brute_by_row(rows, width, units, joined, within):
    """Texts of the rows that are left, in any order: a unit goes if a window over it stands in a row of a smaller id, or earlier in its row."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - width + 1):
            key = tuple(u[k : k + width])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        u, gone, seen = units(t), set(), set()
        for k in range(len(u) - width + 1):
            key = tuple(u[k : k + width])
            if first[key] < order(i) or (within and key in seen):
                gone.update(range(k, k + width))
            seen.add(key)
        out.append((i, joined.join(x for k, x in enumerate(u) if k not in gone)))
    return sorted(out, key=str)


def test_null_and_repeated_ids(spark):
    """Rows of one id whose shared lines and words stand at different places, repeated rows, and a document before them."""
    a, b, c = (f"alpha line {x}\nbeta line {x}\ngamma line {x}\ndelta line {x}" for x in "abc")
    rows = [(None, a), (None, "in front\n" + a), (5, b), (5, "one more\n" + b), (5, b), (None, b), (9, c + "\n" + c), (None, "x\n" + c), (None, "x\n" + c), (7, c), (7, "y\n" + c + "\n" + c)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = sorted([(r.doc_id, r.text) for r in line_dedup.remove_repeated_lines(df).collect()], key=str)
        assert got == brute_by_row(rows, 3, lambda t: t.split("\n"), "\n", True)
        got = sorted([(r.doc_id, r.text) for r in substring_dedup.remove_repeats(df, 4).collect()], key=str)
        assert got == brute_by_row(rows, 4, WORD.findall, " ", False)


def test_windows_remembered_between_passes(docs, rows, monkeypatch):
    """With passes of one document each, and an index partition a few documents large, nothing changes."""
    parts = windows.repeats
    for n in (1 << 18, 5):
        monkeypatch.setattr(windows, "REMEMBERED", n)
        monkeypatch.setattr(windows, "repeats", lambda *a, **k: parts(*a, **k | {"bytes_each": 2000, "sent_bytes": 1}))
        got = substring_dedup.remove_repeats(docs).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_substring(rows)
        assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_repeated_lines(docs).collect()} == brute_lines(rows)


def test_a_full_filter_loses_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(windows, "FILTER_BITS", 64)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()} == brute_substring(rows)


def test_packed_hits():
    at = np.array([3, 4, 900, 2, 70000], np.uint32)
    row, owner, key = np.array([0, 0, 0, 1, 1]), np.array([5, windows.LAST]), np.array([1, 2])
    source = (np.arange(5), np.arange(5, dtype=np.uint32), at)
    x = windows._packed(0, np.arange(5, dtype=np.uint64), row, at, owner, key, False, source)
    hashes, r, a, s, o, k = windows._unpacked([x, x])
    assert [v.tolist() for v in s] == [v.tolist() * 2 for v in source]
    assert a.tolist() == at.tolist() * 2 and o.tolist() == owner.tolist() * 2 and r.tolist() == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3] and hashes.tolist() == [0, 1, 2, 3, 4] * 2 and k.tolist() == [1, 2, 1, 2]


def brute_simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    bits = {i: brute_simhash(t) for i, t in rows}
    root = {i: i for i in bits}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(bits)
    for a in ids:
        for b in ids:
            if a < b and (bits[a] ^ bits[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.bits % (1 << 64), r.component_id) for r in got} == {i: (bits[i], find(i)) for i in ids}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})


def test_simhash_native_hash(spark):
    """The digest is Spark's own ``xxhash64`` of a string."""
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_edges(nulls, empty):
    assert simhash.near_duplicates(empty).count() == 0
    got = simhash.near_duplicates(nulls).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (7, 7), (7, 7), (7, 7)]


def test_links_lose_nothing_when_buckets_are_split(spark):
    """A dense ball with a tiny bucket limit: components equal those of all pairs."""
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 1 << 63, 4, dtype=np.uint64)
    bits = np.unique(np.concatenate([c ^ (np.uint64(1) << draw.integers(0, 64, (100, k), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for c in centre for k in (3, 5)]))
    table = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "bits bigint")
    found = components.connected(simhash.links(table, most=64)).collect()
    root = {int(b): int(b) for b in bits.view(np.int64)} | {r.node: r.root for r in found}
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    label = simhash.forest(len(bits), *np.nonzero(near))
    same = lambda x: {tuple(np.flatnonzero(np.array(x) == v)) for v in set(x)}
    assert same(label.tolist()) == same([root[int(b)] for b in bits.view(np.int64)])


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 100)], "a bigint, b bigint")
    assert {r.node: r.root for r in components.connected(edges).collect()} == {i: 0 for i in range(1, 61)} | {200: 100}


def test_merkle(docs, rows):
    got = {r.doc_id: r for r in merkle.compare_with_next(docs, bytes_each=4000).collect()}
    texts = [t or "" for _, t in sorted(rows, key=lambda r: r[0])]
    ids = sorted(i for i, _ in rows)
    for k, (i, text) in enumerate(zip(ids, texts)):
        after, half = texts[(k + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, (own, new, following) = got[i], merkle.trees([text.encode(), edited.encode(), after.encode()])
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (str(own), str(new)) and str(merkle.parse(str(own))) == str(own)
        assert r.near_edited == merkle.likeness(own, new) and r.near_next == merkle.likeness(own, following)
        assert 0 <= r.near_next <= 1 and (own.root == following.root) == (text == after)
        assert merkle.likeness(merkle.parse(r.fingerprint), merkle.parse(r.edited_fingerprint)) == r.near_edited
        if edited == text:
            assert r.near_edited == 1
    assert len(got) == len(rows)


def plain_tree(text):
    """The fingerprint by plain loops (for texts without very long words)."""
    whole, times, step = 1 << 64, 0x9E3779B97F4A7C15, []

    def hashed(data):
        x = (sum((b + 1) * pow(times, k, whole) for k, b in enumerate(data)) + len(data)) % whole
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % whole
        return x ^ (x >> 31)

    digest = lambda data, n: hashlib.blake2b(data, digest_size=n).hexdigest()
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", text))
    h = [hashed(m[0]) for m in found]
    for i, m in enumerate(found[:-1]):
        least = all(h[i] < h[j] for j in range(max(0, i - 2), i)) and all(h[i] <= h[j] for j in range(i + 1, min(len(h), i + 3)))
        if least or m[0][-1:] in b".!?":
            step.append(m.end())
    cuts = sorted({0, *step, *(m.end() for m in re.finditer(b"\n", text))} - {len(text)}) if text else []
    leaves = {a: text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])}
    sections, held, at = [], [], 0
    lines = re.findall(rb"[^\n]*\n|[^\n]+", text)
    for k, line in enumerate(lines):
        d = digest(line, 8)
        held.append((d, "".join(f"{hashed(x) >> 32:08x}{len(x):04x}" for a, x in leaves.items() if at <= a < at + len(line))))
        at += len(line)
        if k == len(lines) - 1 or int(d[8:], 16) % 4 == 0:
            sections.append((digest("".join(x for x, _ in held).encode(), 16), held))
            held = []
    return digest("".join(x for x, _ in sections).encode(), 16) + "/" + ";".join(x[:8] + ":" + ",".join(d[:8] + below for d, below in ps) for x, ps in sections)


def test_merkle_by_a_plain_tree(rows):
    texts = [(t or "").encode() for _, t in rows]
    some = [t for t in texts if all(len(w) <= merkle.LONG_WORD for w in t.split())]
    assert len(some) > 100 and [str(t) for t in merkle.trees(some)] == [plain_tree(t) for t in some]


def test_merkle_tells_edited_branches(docs, rows, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_RANGES", 3)
    some = 0
    for r in merkle.compare_with_next(docs, bytes_each=500).collect():
        own, new = merkle.parse(r.fingerprint), merkle.parse(r.edited_fingerprint)
        assert [(x.section, x.paragraph) for x in r.edited_branches] == merkle.edits(new, own)
        assert (r.edited_branches == []) == (own.root == new.root) or not set(new.sections) - set(own.sections)
        some += len(r.edited_branches) > 0
    assert some > 50


def test_merkle_locates_edits():
    text = "\n".join(f"paragraph {i} says something of its own here" for i in range(40)).encode()
    a, b = merkle.trees([text, text.replace(b"paragraph 17 says", b"paragraph 17 sang")])
    found = merkle.edits(a, b)
    flat = [(i, j) for i, s in enumerate(a.sections) for j in range(len(s[1]))]
    assert [flat.index(f) for f in found] == [17] and merkle.edits(a, a) == [] and merkle.likeness(a, b) > 0.9


def test_merkle_edges(nulls, empty, spark):
    assert merkle.compare_with_next(empty).count() == 0
    assert merkle.compare_with_next(nulls).count() == 5
    one = merkle.compare_with_next(spark.createDataFrame([(1, "only one")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0
    long = merkle.trees([b"x" * 200_000])[0]
    assert merkle.parse(str(long)) == long


def test_merkle_ranges_of_one_id(spark):
    """Many rows without an id, and many of one id, are split into ranges like others."""
    rows = [(None, f"none {i}") for i in range(60)] + [(3, f"three {i}") for i in range(60)] + [(i, f"own {i}") for i in range(10, 20)] + [(3, None)] * 3
    got = merkle.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), bytes_each=40).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 60
    after = [hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip([f"own {i}" for i in range(10, 19)], [f"own {i}" for i in range(11, 20)])]
    assert [r.edited_sha256 for r in sorted((r for r in got if 10 <= (r.doc_id or 0) < 19), key=lambda r: r.doc_id)] == after


@pytest.mark.parametrize("text", ["one two three four five six seven eight nine ten. " * 3, "no stops here but many plain words that differ from each other all along the line", "日本語の文章には空白がないので長い一語になりますがそれでも半分が同じなら似ているはずです。" * 3, "".join(hashlib.md5(bytes([i])).hexdigest() for i in range(25))])
def test_merkle_sees_half_of_a_short_text(text):
    text = text.strip()
    half = text[: len(text) // 2] + "".join(chr(0x500 + i % 90) + " " * (i % 6 == 5) for i in range(len(text) - len(text) // 2))
    a, b = merkle.trees([text.encode(), half.encode()])
    assert 0.1 < merkle.likeness(a, b) < 0.8


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc def abc  abcd", np.uint8)
    start, end, _ = arrays.words(data, np.array([0, len(data)]))
    h = arrays.span_hashes(data, start, end)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
