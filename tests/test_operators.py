"""Golden cases and invariants of the retrieval operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.functions import keys, models, splitting, text, vectors
from lodestone.operators import chunking, context, dense, fusion, history, lexical, replicate, tables
from lodestone.plans import retrieve
from lodestone.schema import CANONICAL, CHUNK, canonical
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenize(spark):
    tokens = lambda t: one(spark, text.tokenize(F.lit(t)))
    assert tokens("The engine cooling-water temperature must be 60°C!") == ["engine", "cooling-water", "temperature", "60°c"]
    assert tokens("what is the") == [] and tokens(None) == [] and tokens("naïve Été") == ["naïve", "été"]


def test_keys(spark):
    parent = lambda *x: one(spark, keys.parent_id(*(F.lit(v) for v in x)))
    assert parent("engine.pdf", 1, "Ch1 > Cooling", 0) == "par_78e95db1aefb"
    assert parent("engine.pdf", 3, "", 100000) == "par_2ddd80eb9623"
    content = lambda *x: one(spark, keys.content_hash(*(F.lit(v) for v in x)))
    assert content("engine.pdf", 1, "Check coolant level daily.") == "9b03c58f57d1c916aa229147cad8484c"
    assert content("engine.pdf", None, "x") == "dab3ac2e4f82a2e0b31c3d39299297e8"
    for order in (["b", "a"], ["a", "b"]):
        assert replicate.source_hashes(spark.createDataFrame([("s", c) for c in order], "source string, content string")).first().hash == "3ed314e04dea09e99c8a7dbfd15695aa"
    assert replicate.exact_fingerprint(spark.createDataFrame([("id-2",), ("id-1",)], "id string")).first().etag == "fb2aac0d7771648287f61f4efcb57c86"
    two = [replicate.fingerprint(spark.createDataFrame([(f"id-{i}",) for i in ids], "id string")).first().etag for ids in ((1, 2, 3), (3, 1, 2), (1, 2))]
    assert two[0] == two[1] != two[2]


DOCS = ["engine oil pressure alarm", "engine cooling-water temperature", "bilge pump oil oil", "anchor chain", "radar display"]


def test_bm25(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "oil pressure"), (2, "what is the")], "item_id bigint, text string")
    got = lexical.bm25(docs, asked, 5).collect()
    assert [(r.item_id, r.doc_id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0, 1.2479, 1), (1, 2, 0.4342, 2)]
    assert lexical.corpus_stats(docs, "text").first().avgdl == 3.0
    idf = {r.token: round(r.idf, 4) for r in lexical.term_stats(docs, "text").collect()}
    assert idf["oil"] == 0.3365
    assert {r.token: round(r.idf, 4) for r in lexical.term_stats(docs.filter("doc_id < 3"), "text").collect()}["oil"] == 0.0639
    assert {(r.doc_id, r.token): (r.tf, r.dl) for r in lexical.postings(docs, "doc_id", "text").collect()}[2, "oil"] == (2, 4)


def test_dense(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = dense.top_k(points, points.filter("vec_id = 1"), 3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 1.0), (2, 6, 1.0), (3, 3, 0.7071)]
    pair = points.filter("vec_id = 3").select(vectors.cosine("embedding", F.array(F.lit(1.0), F.lit(0.0))).alias("c"), vectors.normalised(F.col("embedding")).alias("n")).first()
    assert round(pair.c, 4) == 0.7071 and round(pair.n[0], 4) == 0.7071


def leg(spark, *rows):
    return spark.createDataFrame(rows, "query_id bigint, id bigint, rank int")


def test_rrf(spark):
    got = {r.id: r for r in fusion.rrf(leg(spark, (1, 1, 1), (1, 2, 2), (1, 3, 1)), leg(spark, (1, 1, 1), (1, 2, 1), (1, 4, 2)), "id").collect()}
    assert (got[1].rrf_score, got[2].rrf_score, got[3].rrf_score, got[4].rrf_score) == (0.032787, 0.032522, 0.016393, 0.016129)
    assert [got[i]["rank"] for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert fusion.above(spark.createDataFrame([(0.5,), (0.1,)], "s double"), "s", 0.2).count() == 1


def with_cosines(spark, *v):
    return spark.createDataFrame([(1, i, x, i) for i, x in enumerate(v, 1)], "query_id bigint, id bigint, v array<double>, rank int")


def test_diversity(spark):
    ids = lambda df, k: [r.id for r in sorted(fusion.diverse(df, "id", "v", k).collect(), key=lambda r: r["rank"])]
    far = with_cosines(spark, [1.0, 0.0], [0.9, 0.436], [0.1, 0.995])
    near = with_cosines(spark, [1.0, 0.0], [1.0, 0.1], [1.0, 0.2])
    assert ids(far, 2) == [1, 3] and ids(near, 2) == [1, 2] and ids(far, 3) == [1, 2, 3] and ids(near, 5) == [1, 2, 3]


def passages(spark, *rows):
    table = [(1, i, p, f"text {i}", f"parent {p}" if p else None, float(10 - i), "s", 1) for i, p in enumerate(rows, 1)]
    return spark.createDataFrame(table, "query_id bigint, rank int, parent_id string, content string, parent_content string, score double, source string, page int")


def test_parents_rerank_and_citations(spark):
    ranked = passages(spark, "a", "a", None, "b", "")
    got = fusion.expand_to_parents(ranked).orderBy("rank").collect()
    assert [r.content for r in got] == ["parent a", "text 3", "parent b", "text 5"] and [r["rank"] for r in got] == [1, 2, 3, 4]
    top = fusion.rerank(ranked, F.when(F.col("rank") > 3, 0.9).otherwise(0.5), 3).orderBy("rank").collect()
    assert [r.content for r in top] == ["text 4", "text 5", "text 1"] and top[0].retrieval_score == 6.0
    assert fusion.rerank(ranked, F.lit(0.1), 3, least=0.2).count() == 0
    cited = context.citations(ranked).orderBy("number").collect()
    assert [(r.number, r["rank"], r.citation) for r in cited] == [(1, 1, "[1] s, p. 1"), (2, 3, "[2] s, p. 1"), (3, 4, "[3] s, p. 1")]
    assert context.citations(ranked, F.concat("source", F.lit("|"), F.col("page").cast("string"))).count() == 1


def test_context(spark):
    blocks = spark.createDataFrame([(1, 1, "a" * 10), (1, 2, "b" * 15), (1, 3, "c" * 5)], "query_id bigint, rank int, block string")
    kept = context.within_limit(blocks, 20)
    assert [r["rank"] for r in kept.collect()] == [1] and context.packed(blocks, "+").first().context == "a" * 10 + "+" + "b" * 15 + "+" + "c" * 5
    assert one(spark, context.mode(F.lit(" \n"), F.lit(0.9))) == "general" and one(spark, context.mode(F.lit("x"), F.lit(0.1))) == "grounded"
    head = spark.createDataFrame([("a.pdf", 2, "", "H"), (None, None, None, None)], "source string, page int, section_path string, heading string")
    assert [r.h for r in head.select(context.header().alias("h")).collect()] == ["[Source: a.pdf | Page: 2 | Section: H]", "[Source: unknown]"]


def test_sections_and_breadcrumbs(spark):
    rows = [(1, "heading", "A"), (1, "text", "A"), (2, "text", "A"), (2, "heading", "A > B"), (2, "text", "A > B")]
    blocks = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "source string, ord int, page int, type string, section_path string")
    assert [r["count"] for r in chunking.sections(blocks, "ord").groupBy("section").count().orderBy("section").collect()] == [2, 1, 2]
    heads = spark.createDataFrame([("s", i, x, c) for i, (x, c) in enumerate([(1, "X"), (3, "Y"), (2, "Z"), (None, "text"), (1, "W")])], "source string, ord int, level int, content string")
    got = chunking.breadcrumbs(heads, "ord").orderBy("ord").collect()
    assert [r.section_path for r in got] == ["X", "X > Y", "X > Z", "X > Z", "W"] and [r.heading for r in got] == ["X", "Y", "Z", "Z", "W"]


def test_numbered_walk_is_that_of_the_chunkers(spark):
    draw = random.Random(7)
    rows = []
    for i in range(400):
        kind = draw.choice(["heading", "text", "text", "table", "image", "bullet"])
        rows.append((draw.choice(["a", "b", None]), i, draw.choice([1, 1, 2, None]), kind, draw.choice([1, 2, 3]) if kind == "heading" else None, draw.choice(["", "  ", None, "word", "some words"])))
    table = spark.createDataFrame(rows, "source string, ord int, page int, type string, level int, content string").repartition(5)
    plain, walked = chunking.breadcrumbs(table, "ord"), chunking.breadcrumbs(table, "ord", numbered=True)
    for strategy in chunking.available_strategies():
        a, b = (sorted(map(str, chunking.chunker(strategy)(x, "ord").collect())) for x in (plain, walked))
        assert a == b and len(a) > 50
    section = {(r.source, r.ord): r.section for r in chunking.sections(plain.filter("type NOT IN ('table', 'image')"), "ord").collect()}
    outline = {(r.source, r.ord): r.section for r in chunking.outline(table, "ord").collect()}
    assert len(outline) == 400 and all(outline[k] == v for k, v in section.items())
    # The plain walk.
    last, begun = {}, {}
    crumbs = {(r.source, r.ord): r.section_path for r in plain.collect()}
    for source, i, page, kind, level, _ in rows:
        if kind in chunking.ATOMIC:
            continue
        here = (crumbs[source, i], page)
        begun[source] = 0 if source not in last else begun[source] + (kind == "heading" or last[source] != here)
        last[source] = here
        assert section[source, i] == begun[source]


def test_blocks_from_spans(spark):
    spans = [(1, 0, 0, 0, "Title", 20.0), (1, 1, 0, 0, "some body ", 10.0), (1, 1, 0, 1, "text", 10.0), (1, 2, 0, 0, "- an item", 10.0), (1, 3, 0, 0, "Sub", 12.0), (1, 4, 0, 0, "  ", 10.0), (1, 5, 0, 0, "more", 10.0)]
    table = spark.createDataFrame([("s", *x) for x in spans], "source string, page int, block int, line int, span int, text string, size double")
    got = chunking.blocks(table).orderBy("block").collect()
    assert [(r.content, r.type, r.level) for r in got] == [("Title", "heading", 1), ("some body text", "text", None), ("- an item", "bullet", None), ("Sub", "heading", 3), ("more", "text", None)]
    sizes = spark.createDataFrame([("s", 1, x) for x in (8.0, 10.0, 12.0, 14.0)], "source string, page int, size double")
    assert chunking.body_size(sizes).first().body == 12.0


def test_splitters():
    assert splitting.fixed("aa\nbb\ncc", 5, 2) == ["aa\nbb", "bb\ncc"]
    assert splitting.fixed("long line here\nx", 5, 0) == ["long line here", "x"]
    assert splitting.recursive("one two three four", 9, 0) == ["one two", "three", "four"]
    assert splitting.recursive("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert splitting.recursive("Para one.\n\nPara two is longer.", 12, 0) == ["Para one.", "Para two is", "longer."]
    assert splitting.recursive("", 4, 1) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n!?é", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_splitter_properties(said, size, overlap):
    chunks = splitting.recursive(said, size, overlap)
    assert all(0 < len(c) <= size and c in said and c == c.strip() for c in chunks)
    assert set("".join(said.split())) == set("".join("".join(chunks).split()))


def test_hierarchical(spark):
    body = " ".join(f"word{i}" for i in range(400))
    rows = [("s", 0, 1, "heading", 1, "H"), ("s", 1, 1, "text", None, body), ("s", 2, 1, "table", None, "| a |"), ("s", 3, 2, "image", None, "  ")]
    blocks = chunking.breadcrumbs(spark.createDataFrame(rows, "source string, ord int, page int, type string, level int, content string"), "ord")
    got = chunking.chunker("hierarchical")(blocks, "ord").collect()
    text_chunks = [r for r in got if r.type == "heading"]
    assert all(len(r.content) <= 512 and len(r.parent_content) <= 1500 and r.content in r.parent_content for r in text_chunks)
    assert {r.parent_id for r in text_chunks} > {one(spark, keys.parent_id(F.lit("s"), F.lit(1), F.lit("H"), F.lit(0)))}
    assert [(r.content, r.chunk_index, r.total_chunks) for r in got if r.type == "table"] == [("| a |", 0, 1)] and not [r for r in got if r.type == "image"]
    assert chunking.available_strategies() == ["fixed", "hierarchical", "recursive"] and chunking.chunker("fixed")(blocks, "ord").filter("strategy = 'none'").count() == 1
    with pytest.raises(ValueError):
        chunking.chunker("flat")
    stats = chunking.chunk_stats(chunking.chunker("hierarchical")(blocks, "ord")).first()
    assert stats.n_chunks == len(got) and stats.max_length <= 512 and chunking.chunk_stats(blocks.filter("false")).count() == 0


def test_replication(spark):
    table = lambda *ids: spark.createDataFrame([(i, v) for i, v in ids], "id bigint, v string")
    cloud, local = table((1, "a"), (2, "b"), (3, "c")), table((2, "b"), (3, "x"), (4, "d"))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(replicate.to_pull(cloud, local)) == [1] and ids(replicate.to_pull(cloud, local, version="v")) == [1, 3] and ids(replicate.stale(cloud, local)) == [4]
    after = replicate.synced(cloud, local, version="v")
    assert sorted(after.collect()) == sorted(cloud.collect()) == sorted(replicate.synced(cloud, after, version="v").collect())
    assert ids(replicate.synced(cloud, local, origin=F.col("id") < 4)) == [1, 2, 3, 4]


def test_diff_pages_and_urls(spark):
    table = lambda *rows: spark.createDataFrame(rows, "source string, hash string")
    got = replicate.diff(table(("a", "1"), ("b", "2"), ("c", "3")), table(("a", "1"), ("b", "9"), ("d", "4")))
    assert {r.source: r.status for r in got.collect()} == {"a": "unchanged", "b": "add", "c": "add", "d": "delete"}
    rows = spark.range(5)
    pages = [replicate.page_of(rows, "id", o, 2).collect() for o in (0, 2, 4)]
    assert [[r.id for r in p] for p in pages] == [[0, 1], [2, 3], [4]] and [p[0].has_more for p in pages] == [True, True, False]
    with pytest.raises(ValueError):
        replicate.page_of(rows, "id", -1, 2)
    chunks = spark.createDataFrame([(1, "http://x/a.pdf", "a.pdf"), (2, "http://x/a.pdf", "b.pdf"), (3, " ", "c"), (4, "http://x/d.pdf", "")], "ord int, source_url string, source string")
    assert {r.source_url[-5:]: r.filename for r in replicate.urls(chunks, "ord").collect()} == {"a.pdf": "a.pdf", "d.pdf": "d.pdf"}
    manifest = spark.createDataFrame([(0, "a.pdf", "u1"), (1, "a.pdf", "u2"), (2, "b.pdf", "u3")], "ord int, filename string, url string")
    files = spark.createDataFrame([("b.pdf",)], "filename string")
    assert [(r.filename, r.url) for r in replicate.downloads(chunks, manifest, files).collect()] == [("a.pdf", "u2")]
    log = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in range(1, 29)] * 2, "timestamp string")
    assert replicate.last_log(log).count() == 50
    assert [r.id for r in replicate.first_of(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, k string"), "id", "k").orderBy("id").collect()] == [1, 3]


def test_export(spark):
    chunks = spark.createDataFrame([(1, "s", 1, "text a"), (2, "s", 1, "text b"), (3, "s", 1, "text a")], "id int, source string, page int, content string")
    points = spark.createDataFrame([(7, "s", 1, "text a", [1.0]), (8, "s", 1, "text a", [2.0]), (9, "s", 1, "text b", None)], "id int, source string, page int, content string, vector array<float>")
    assert {r.id: r.embedding for r in replicate.export(chunks, points).collect()} == {1: [2.0], 2: None, 3: [2.0]}


def test_history(spark):
    turns = spark.createDataFrame([(1, i, r, f"{r[0]}{i}") for i, r in enumerate(["user", "assistant", "system", "user", "assistant"])], "conv_id bigint, turn bigint, role string, text string")
    got = history.history(turns, 1).orderBy("turn", "position").collect()
    assert [(r.turn, r.text) for r in got] == [(0, "u0"), (3, "a1"), (3, "u3")]
    assert [(r.turn, r.question) for r in history.question_before(turns).orderBy("turn").collect()] == [(1, "u0"), (4, "u3")]
    assert [r.prompt for r in history.summary_prompts(turns, every=2, cut=1).collect()] == ["User: u\nAssistant: a\nUser: u\nAssistant: a"]


def test_tables(spark):
    assert one(spark, text.markdown(F.lit([[" a ", ""], ["1", "2"]]))) == "| a |  |\n|---|---|\n| 1 | 2 |"
    assert one(spark, text.markdown(F.lit([["a"]]))) == ""
    df = spark.createDataFrame([(1, " x ", None), (None, None, None), (3, "y", None)], "a int, b string, c string")
    cleaned = tables.clean(df)
    assert cleaned.columns == ["a", "b"] and sorted(map(tuple, cleaned.collect())) == [(1, "x"), (3, "y")]
    got = {r["column"]: r for r in tables.profile(df).collect()}
    assert (got["a"].n_rows, got["a"].n_null, got["a"].low, got["a"].high, got["a"].mean) == (3, 1, 1.0, 3.0, 2.0) and got["b"].low is None
    assert tables.to_markdown(cleaned, "a", 1).first().markdown == "| a | b |\n|---|---|\n| 1 | x |"
    assert tables.json_rows(cleaned.filter("a = 1")).first().json == '{"a":1,"b":"x"}'


def test_canonical(spark):
    got = canonical(spark.createDataFrame([("x", None, 0.123456)], "content string, source string, score double")).first()
    assert list(got.asDict()) == list(CANONICAL) and (got.content, got.source, got.type, got.score, got.page) == ("x", "unknown", "text", 0.1235, None)
    assert spark.createDataFrame([], CHUNK).count() == 0


def test_text_functions(spark):
    bullets = ["- x", "12. y", "a) z", "plain\n• item", "no-item", "-none"]
    assert [one(spark, text.has_bullet(F.lit(b))) for b in bullets] == [True, True, True, True, False, False]
    assert one(spark, text.preview(F.lit("a\nb\nc\nd"))) == "a\nb\nc" and one(spark, text.preview(F.lit("a\nb"))) == "a\nb"
    assert one(spark, text.strip(F.lit(" \n x y\t"))) == "x y" and one(spark, text.breadcrumb(F.lit("A > B/C"))) == ["A", "B", "C"]
    assert [one(spark, f(F.lit("/d/e.f/Report.v2.PDF"))) for f in (text.extension, text.file_name, text.stem)] == [".pdf", "Report.v2.PDF", "Report.v2"]
    assert one(spark, text.highlight(F.lit("Oil pump (a+b)"), "the oil (a+b)")) == "<mark>Oil</mark> pump <mark>(a+b)</mark>"
    assert [one(spark, text.confidence_band(F.lit(s))) for s in (1.7, 0.5, -1.0)] == ["high", "medium", "low"]
    assert one(spark, text.or_else(F.lit(""), F.lit("b"))) == "b" and one(spark, vectors.highlight_box(F.lit([10.0, 20.0, 200.0, 250.0]), F.lit(100.0), F.lit(100.0))) == [0.1, 0.2, 2.0, 2.5]


def test_models(spark):
    got = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(models.embed(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-6 and not any(got[1].v) and not any(got[2].v)
    with pytest.raises(LookupError):
        models.embed(F.col("t"), "no such model")
    assert one(spark, models.overlap(F.lit("oil pressure"), F.lit("the oil"))) == 0.5 and one(spark, models.overlap(F.lit("the"), F.lit("x"))) == 0.0
    assert one(spark, models.generate(F.lit("echo me"))) == "echo me"


def test_plan(spark):
    chunks = spark.createDataFrame([(i, t, "s", 1, "text", "", "", f"p{i}", t) for i, t in enumerate(DOCS)], "id bigint, content string, source string, page int, type string, heading string, section_path string, parent_id string, parent_content string").withColumn("vector", models.embed(F.col("content")))
    asked = spark.createDataFrame([(1, "oil pressure"), (2, "zzz")], "query_id bigint, text string").withColumn("vector", models.embed(F.col("text"), query=True))
    got = retrieve.hybrid(chunks, asked, pin=F.col("id") < 3)
    assert {r.id for r in got.collect()} <= {0, 1, 2}
    top = retrieve.answer_passages(chunks, asked)
    assert top.filter("query_id = 1 AND rank = 1").first().content == DOCS[0] and top.groupBy("query_id").count().filter("count > 5").count() == 0
    prompts = {r.query_id: r for r in retrieve.prompts(top, asked).collect()}
    assert prompts[1]["mode"] == "grounded" and DOCS[0] in prompts[1].prompt and prompts[2]["mode"] == "general" and prompts[2].prompt == "zzz"
