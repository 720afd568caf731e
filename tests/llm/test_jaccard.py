"""The pipeline's near-dedup against brute-force groups by five-word Jaccard similarity."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, jaccard, simhash


def shingles(text, width=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def near_copies():
    """Copies with a word or a few changed, in chains too, and unlike texts that share a passage."""
    draw = random.Random(3)
    words = lambda k: [f"w{draw.randrange(5000)}" for _ in range(k)]
    texts, passage = [], words(30)
    for _ in range(12):
        texts.append(base := words(draw.randint(6, 120)))
        for _ in range(6):
            base = list(base)
            base[draw.randrange(len(base))] = f"x{draw.randrange(9999)}"
            texts.append(base)
    texts += [words(3) + passage + words(draw.randint(1, 12)) for _ in range(30)] + [passage + [f"y{i}"] for i in range(30)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("ways", [{}, {"most": 3}, {"most": 3, "block": 4}, {"most": 3, "gathered": 50, "block": 4}])
def test_groups(spark, rows, ways):
    table = rows + [(1000 + i, t) for i, t in near_copies()]
    got = jaccard.groups(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3), **ways)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(table)


def test_no_row_holds_a_shingle_of_all_classes(spark):
    """A shingle in front of all 5,000 classes, others in front of few: whole buckets, in bounded rows and blocks."""
    entries = [(7, i, i << 32) for i in range(5000)] + [(100 + i // 2, i, i << 32) for i in range(5000)] + [(9000, i, i << 32) for i in range(5)] + [(9999, 1, 1 << 32)]
    fronts = spark.createDataFrame(entries + entries[:100], "token bigint, node bigint, place bigint")
    few, large = jaccard._gathered(fronts, 5000, 3, 400)
    assert sorted(sorted(m.node for m in r.members) for r in few.collect()) == [[i, i + 1] for i in range(0, 5000, 2)]
    found = sorted((r.token, r.node, r.total) for r in large.collect())
    assert found == [(7, i, 5000) for i in range(5000)] + [(9000, i, 5) for i in range(5)]
    blocks = F.ceil(F.col("total") / 400).cast("int")
    placed = large.select("token", "node", "place", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int").alias("block"))
    assert max(r.n for r in jaccard._with_stars(placed).select(F.size("members").alias("n")).collect()) < 500
    rooted = placed.withColumns({"root": F.col("node") % 9, "bits": F.lit(b"")})
    rows = [[(m.node, m.side) for m in r.members] for r in jaccard._by_blocks(rooted).collect()]
    assert max(map(len, rows)) < 1000
    met = set()
    for row in rows:
        met.update((a, b) for a, x in row for b, y in row if a < b and (x == y == 0 or x != y))
    assert len(met) == 5000 * 4999 // 2
    assert {len(r.members) for r in jaccard._by_blocks(rooted.withColumn("root", F.lit(1))).collect()} == {5}


def test_fronts_of_one_class_are_neither_stored_nor_sent_again(spark):
    """More classes than are gathered together: what a sketch does not count as common is whole after one shuffle, and only shingles of several classes are left."""
    entries = [(i * 7919 % (1 << 62), i % 5000, (9 << 32) + 1) for i in range(20000)] + [(-5 - i // 3, i, i << 32) for i in range(60)] + [(-4, i, i << 32) for i in range(9)]
    fronts = spark.createDataFrame(entries + entries[-50:], "token bigint, node bigint, place bigint")
    few, large = jaccard._gathered(fronts, 5000, 3, 400, len(entries), np.zeros(jaccard.SLOTS, np.uint8))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, large)]
    assert not any("Exchange" in p or "Join" in p for p in plans)
    assert sorted(sorted((m.node, m.place) for m in r.members) for r in few.collect()) == [[(j, j << 32) for j in range(i, i + 3)] for i in range(0, 60, 3)]
    assert sorted((r.node, r.place, r.total) for r in large.collect()) == [(i, i << 32, 9) for i in range(9)]


@pytest.mark.parametrize("split", [1, 3])
def test_packets_bring_classes_together(split):
    """Packets of two tasks: only shingles of several classes are left, common ones by parts; two that share their bits count as one."""
    import pyarrow as pa

    high = 1 << jaccard.TOKEN_BITS
    entries = [(100 + i, i, i) for i in range(50)] + [(7, i, i << 32) for i in range(40)] + [(5 + high, 60, 2), (5, 61, 3), (5, 60, 4)]
    batches = [pa.table([pa.array(x, pa.int64()) for x in zip(*some)], ["token", "node", "place"]).to_batches() for some in (entries[::2], entries[1::2] + entries[:60])]
    common = np.zeros(jaccard.SLOTS, bool)
    common[7] = True
    sent = [b for some in batches for b in jaccard._packets(4, split, common)(iter(some))]
    got = [r for b in jaccard._met(4)(iter(sent)) for r in b.to_pylist()]
    found = sorted((r["token"], r["part"], [(m["node"], m["place"]) for m in r["members"]]) for r in got)
    whole = [(7, -1, [(i, i << 32) for i in range(40)])] if split == 1 else [(7, p, [(i, i << 32) for i in range(p, 40, 3)]) for p in range(3)]
    assert found == [(5, -1, [(60, 2), (61, 3)]), *whole]
    homes = {int(k) % 4 for b in sent for k, n, blob in zip(*(b.column(c).to_pylist() for c in ("key", "n", "entries"))) if k >= 4}
    assert len(homes) == (0 if split == 1 else 3)


def test_stage_removes_copies_of_four_fifths(spark, rows):
    table = rows + [(1000 + i, t) for i, t in near_copies()]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in table], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in brute_groups(table).items() if i == r)


def test_classes_meet_by_simhash(spark, rows, monkeypatch):
    """Candidates connect exactly the texts that SimHash of the stage's width connects, and the stage verifies them."""
    table = rows + [(1000 + i, t) for i, t in near_copies()]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, jaccard.SHINGLE).collect()}
    asked, verified, made, meet = [], jaccard._verified, [], jaccard.met_by_simhash
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *others: asked.append(pairs) or verified(pairs, *others))
    monkeypatch.setattr(jaccard, "met_by_simhash", lambda classes: made.append((classes, meet(classes))) or made[0][1])
    groups = {r.doc_id: r.component_id for r in jaccard.groups(docs).collect()}
    (classes, pairs), = made
    assert pairs.count() and not pairs.exceptAll(asked[0]).count()
    least = {r.node: r.least for r in classes.collect()}
    roots = {r.node: r.root for r in components.connected(pairs).collect()}
    met, together = {}, {}
    for node, doc in least.items():
        met.setdefault(roots.get(node, node), set()).add(doc)
        together.setdefault(linked[doc], set()).add(doc)
    assert sorted(map(sorted, met.values())) == sorted(map(sorted, together.values()))
    # SimHash alone would leave similar texts apart; the stage does not.
    assert groups == brute_groups(table) and any(groups[a] == groups[b] and linked[a] != linked[b] for a in least.values() for b in least.values())


def test_fingerprints_rule_out_no_similar_pair():
    """Sets around the least similarity, of many sizes: every similar pair stays open, and most of the others do not."""
    draw = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 5, 20, 100, 400):
        base = draw.integers(0, 1 << 62, n, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.2, 0.3, 0.5):
            some = base.copy()
            some[: int(n * share)] = draw.integers(0, 1 << 62, int(n * share), dtype=np.uint64)
            sets.append(np.unique(some))
    bits = np.frombuffer(b"".join(map(jaccard.parities, sets)), np.uint64).reshape(len(sets), -1)
    test = jaccard.near(bits, np.array([len(s) for s in sets]))
    open_pairs = similar = 0
    for i, s in enumerate(sets):
        left = set(test(i, np.arange(len(sets))).tolist())
        for j, t in enumerate(sets):
            common = len(np.intersect1d(s, t))
            if 5 * common >= 4 * (len(s) + len(t) - common):
                assert j in left
                similar += 1
        open_pairs += len(left)
    assert open_pairs < 2 * similar


def test_a_class_of_a_third_of_all_rows(spark):
    table = [(i, "the same text of some words") for i in range(40)] + [(40 + i, f"text {i} stands alone {i * 7} here") for i in range(80)]
    got = jaccard.groups(spark.createDataFrame(table, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: 0 if i < 40 else i for i in range(120)}


def test_edges(empty, nulls):
    assert jaccard.keep_one(empty).count() == 0
    kept = jaccard.keep_one(nulls)
    assert kept.columns == nulls.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "7", "7", "None", "None"]
