"""The registered queries over the driver's tables, and the SQL that says the same.

``documents`` stand for chunks (pages, parents and block types are derived from ids, so synthetic), ``benchmark`` for queries,
``embeddings`` for points, ``conversations`` for chats, ``events`` for connectivity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import keys, models, text
from lodestone.operators import chunking, context, dense, fusion, history, lexical, replicate, stages, tables
from lodestone.operators.cells import VectorIndex
from lodestone.operators.digests import Digests, replicate_by_digests
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.pages import Pages
from lodestone.operators.store import TableStore
from lodestone.plans import retrieve
from lodestone.schema import canonical
from lodestone.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", (F.col("doc_id") % 7 + 1).cast("int").alias("page"), F.lit("text").alias("type"), F.col("lang").alias("heading"), F.col("lang").alias("section_path"))
    parent = keys.parent_id(F.col("source"), F.col("page"), F.col("section_path"), F.lit(0))
    return docs.withColumns({"parent_id": parent, "parent_content": F.concat(F.lit("Parent "), "source", F.lit(" "), F.col("page").cast("string"))})


_CHUNKS = """c AS (SELECT *, 'par_' || substr(md5(source || '|p' || page || '|' || section_path || '|0'), 1, 12) AS parent_id, 'Parent ' || source || ' ' || page AS parent_content
    FROM (SELECT doc_id AS id, text AS content, source, doc_id % 7 + 1 AS page, lang AS heading, lang AS section_path FROM documents))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as ranked for queries: every 16 consecutive ids answer one query."""
    rows = _chunks(spark, sf_dir).withColumns({"query_id": F.floor(F.col("id") / 16), "score": F.round(1 / (1 + F.col("id") % 16), 4)})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).cast("bigint"))


_RANKED = _CHUNKS + """, r AS (SELECT *, id // 16 AS query_id, round(1.0::DOUBLE / (1 + id % 16), 4) AS score, row_number() OVER (PARTITION BY id // 16 ORDER BY id) AS rank FROM c)"""
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _tokens_sql(column: str) -> str:
    return rf"[x FOR x IN regexp_split_to_array(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s.\-°/%]', ' ', 'g'), '\s+') IF length(x) >= 2 AND x NOT IN ({_STOP})]"


_TERMS = f"""d AS MATERIALIZED (SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents),
    t AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM d) GROUP BY ALL),
    raw AS MATERIALIZED (SELECT token, count(*) AS df, ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM t GROUP BY token),
    idf AS MATERIALIZED (SELECT token, df, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _bm25_sql(k: int) -> str:
    return f"""{_TERMS}, q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_tokens_sql('text')}) AS token FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / (SELECT avg(len(tokens)) FROM d)))) AS score
          FROM q JOIN t USING (token) JOIN idf USING (token) JOIN d USING (doc_id) GROUP BY ALL),
    bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


@_query(f"WITH d AS (SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents) SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct FROM d")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@_query(f"WITH {_TERMS} SELECT token, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(_table(spark, sf_dir, "documents"), "text").select("token", "df", F.round("idf", 6).alias("idf"))


@_query(f"WITH {_bm25_sql(20)} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


@_query(f"WITH {_bm25_sql(20)} SELECT item_id, doc_id, round(score, 4) AS score, rank FROM bm25")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an inverted index, which is made first."""
    index = InvertedIndex(spark, stages.folder(spark))
    index.append(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.search(_table(spark, sf_dir, "benchmark"), 20, "doc_id", "item_id")


def _dense_sql(queries: str, points: str, k: int) -> str:
    return f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    dense AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank
        FROM (SELECT q.vec_id AS query_id, p.vec_id, list_cosine_similarity(q.e, p.e) AS score FROM (SELECT * FROM v WHERE {queries}) q, (SELECT * FROM v WHERE {points}) p)) WHERE rank <= {k})"""


@_query(f"WITH {_dense_sql('vec_id % 20 = 0', 'true', 20)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings")
    return dense.top_k(points, points.filter("vec_id % 20 = 0"), 20)


def _cells(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """A vector index of all embeddings, and the query set."""
    index, points = VectorIndex(spark, stages.folder(spark)), _table(spark, sf_dir, "embeddings")
    index.build(points, "vec_id", "embedding")
    return index, points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@_query()
def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest by an index that reads a few lists; a test holds its recall."""
    index, asked = _cells(spark, sf_dir)
    return index.search(asked, 20)


@_query(f"WITH {_dense_sql('vec_id % 20 = 0', 'true', 20)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM dense")
def dense_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _cells(spark, sf_dir)
    return index.search(asked, 20, exact=True)


@_query(f"WITH {_dense_sql('vec_id % 20 = 0', 'label = 3', 5)} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM dense")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings")
    return dense.top_k(points.filter(F.col("label") == F.lit(3)), points.filter("vec_id % 20 = 0"), 5)


@_query(
    f"""WITH {_bm25_sql(60)}, {_dense_sql('vec_id IN (SELECT item_id FROM benchmark)', 'true', 60)},
    legs AS (SELECT query_id, vec_id AS doc_id, rank AS r, 0 AS leg FROM dense UNION ALL SELECT item_id, doc_id, rank, 1 FROM bm25),
    f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + r)) AS s, min(r) FILTER (leg = 0) AS a, min(r) FILTER (leg = 1) AS b FROM legs GROUP BY ALL)
    SELECT query_id, doc_id, round(s, 6) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, a NULLS LAST, b NULLS LAST, doc_id) AS rank FROM f"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, asked = _table(spark, sf_dir, "embeddings"), _table(spark, sf_dir, "benchmark")
    vectors = points.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.top_k(points, vectors, 60).withColumnRenamed("vec_id", "doc_id")
    words = lexical.bm25(_table(spark, sf_dir, "documents"), asked, 60).withColumnRenamed("item_id", "query_id")
    return fusion.rrf(near, words, "doc_id")


@_query(r"""SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY regexp_replace(text, '^\s+|\s+$', '', 'g')""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(text.strip(F.col("text")), 256)
    return _table(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).drop("k")


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return files.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha256")


@_query(f"WITH {_CHUNKS} SELECT id, content, source, page, 'text' AS type, heading, section_path, '' AS image_path, parent_id, parent_content, NULL::INTEGER AS chunk_index, NULL::INTEGER AS total_chunks, 0.0::DOUBLE AS score, NULL::DOUBLE AS page_width, NULL::DOUBLE AS page_height, '' AS source_url FROM c")
def canonical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(_chunks(spark, sf_dir), "id").drop("bbox")


@_query(f"WITH {_CHUNKS} SELECT id, parent_id, md5(source || '|' || page || '|' || substr(content, 1, 80)) AS content_hash FROM c")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", "parent_id", keys.content_hash(F.col("source"), F.col("page"), F.col("content")).alias("content_hash"))


@_query(f"""WITH {_RANKED}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM r)
    SELECT query_id, parent_id, parent_content AS content, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM f WHERE n = 1""")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.expand_to_parents(_ranked(spark, sf_dir)).select("query_id", "parent_id", "content", "rank")


_BLOCKS = _RANKED + """, b AS (SELECT query_id, rank, '[Source: ' || source || ' | Page: ' || page || ' | Section: ' || section_path || ']' || chr(10) || content AS block FROM r),
    w AS (SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM b) WHERE total <= 6000)"""


@_query(f"WITH {_BLOCKS} SELECT query_id, count(*) AS n_blocks, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM w GROUP BY query_id")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = context.within_limit(context.blocks(_ranked(spark, sf_dir)))
    n = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return context.packed(kept).join(n, "query_id").select("query_id", "n_blocks", F.md5("context").alias("context_md5"))


@_query(f"""WITH {_RANKED}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM r),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS number FROM f WHERE n = 1)
    SELECT query_id, number, rank, source, page, parent_id, '[' || number || '] ' || source || ', p. ' || page AS citation FROM g""")
def citations_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.citations(_ranked(spark, sf_dir)).withColumn("page", F.col("page").cast("bigint"))


@_query(f"""WITH {_RANKED} SELECT query_id, CASE WHEN max(score) FILTER (rank = 1) < 0.1 THEN 'general' ELSE 'grounded' END AS mode, max(score) FILTER (rank = 1) AS best FROM r GROUP BY query_id""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    best = context.best_score(ranked, ranked.select("query_id").distinct())
    return best.select("query_id", context.mode(F.lit("context"), F.col("best")).alias("mode"), "best")


@_query(f"WITH {_RANKED} SELECT query_id, rank, source, page, heading, section_path, parent_content AS content, score, 'text' AS chunk_type FROM r")
def offline_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {c: F.lit(None).cast(t) for c, t in (("bbox", "array<double>"), ("page_width", "double"), ("page_height", "double"))}
    return context.cards(_ranked(spark, sf_dir).withColumns(none)).drop("bbox", "page_width", "page_height").withColumn("page", F.col("page").cast("bigint"))


@_query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.sources(_table(spark, sf_dir, "documents"))


_HASHES = "h AS (SELECT source, md5(string_agg(m, '|' ORDER BY m)) AS hash FROM (SELECT source, md5(text) AS m FROM documents WHERE source <> '') GROUP BY source)"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.source_hashes(_table(spark, sf_dir, "documents").select("source", F.col("text").alias("content")))


@_query(f"WITH {_HASHES} SELECT * FROM h")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir)


@_query(f"""WITH {_HASHES}, k AS (SELECT CASE WHEN source LIKE '%7' THEN source || '-old' ELSE source END AS source, CASE WHEN source LIKE '%5' THEN reverse(hash) ELSE hash END AS hash FROM h WHERE source NOT LIKE '%3')
    SELECT coalesce(h.source, k.source) AS source, CASE WHEN h.hash IS NULL THEN 'delete' WHEN h.hash = k.hash THEN 'unchanged' ELSE 'add' END AS status FROM h FULL JOIN k ON h.source = k.source""")
def kb_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's table is the server's with some sources missing, changed or renamed."""
    server = _hashes(spark, sf_dir)
    renamed = F.when(F.col("source").endswith("7"), F.concat("source", F.lit("-old"))).otherwise(F.col("source"))
    client = server.filter(~F.col("source").endswith("3")).select(renamed.alias("source"), F.when(F.col("source").endswith("5"), F.reverse("hash")).otherwise(F.col("hash")).alias("hash"))
    return replicate.diff(server, client)


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two collections: all embeddings, and a client's copy, from which some rows are missing, some are of an older version and some have another id."""
    points = _table(spark, sf_dir, "embeddings")
    cloud = points.select(F.col("vec_id").alias("id"), "label", F.lit(1).alias("version"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    renamed = F.when(F.col("label") == 7, F.col("id") + 1_000_000_000).otherwise(F.col("id"))
    local = cloud.filter("label <> 3").select(renamed.alias("id"), "label", F.when(F.col("label") == 5, 0).otherwise(F.col("version")).alias("version"), "first")
    return cloud, local


_REPLICAS = """cloud AS (SELECT vec_id AS id, label, 1 AS version, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings),
    local AS (SELECT CASE WHEN label = 7 THEN id + 1000000000 ELSE id END AS id, label, CASE WHEN label = 5 THEN 0 ELSE version END AS version, first FROM cloud WHERE label <> 3)"""


@_query(f"WITH {_REPLICAS} SELECT * FROM cloud c WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.id = c.id AND l.version = c.version)")
def sync_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.to_pull(*_replicas(spark, sf_dir), version="version")


@_query(f"WITH {_REPLICAS} SELECT * FROM local l WHERE NOT EXISTS (SELECT 1 FROM cloud c WHERE l.id = c.id)")
def sync_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.stale(*_replicas(spark, sf_dir))


@_query(f"WITH {_REPLICAS} SELECT * FROM cloud")
def sync_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.synced(*_replicas(spark, sf_dir), version="version")


@_query(f"WITH {_REPLICAS} SELECT count(*) AS pending FROM cloud c WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.id = c.id AND l.version = c.version)")
def sync_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.to_pull(*_replicas(spark, sf_dir), version="version").agg(F.count(F.lit(1)).alias("pending"))


@_query("SELECT doc_id, source, (SELECT count(*) FROM documents) AS total, 150 < (SELECT count(*) FROM documents) AS has_more FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def export_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.page_of(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 50)


_PAGE = "SELECT doc_id, source, (SELECT count(*) FROM documents) AS total, 150 < (SELECT count(*) FROM documents) AS has_more FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100"


@_query(f"SELECT * FROM ({_PAGE}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def export_page_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page less what repeats a source in it; ``total`` and ``has_more`` are of all rows."""
    return replicate.export_page(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 100, 50)


@_query(_PAGE)
def export_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page from ordered files, which are written first."""
    pages = Pages(spark, stages.folder(spark))
    pages.write(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return pages.page(100, 50)


@_query(f"WITH {_REPLICAS} SELECT * FROM cloud")
def sync_by_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local store after a replication that reads differing buckets only."""
    sides = []
    for rows in _replicas(spark, sf_dir):
        folder, schema = stages.folder(spark), ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        sides.append((TableStore(spark, f"{folder}/store", schema, bucket=2), Digests(spark, f"{folder}/tree", ("id", "version"))))
        sides[-1][0].publish(rows)
    (cloud, there), (local, here) = sides
    replicate_by_digests(cloud, local, there, here, "version")
    return local.read()


@_query(f"WITH {_REPLICAS}, kept AS (SELECT * FROM local WHERE label <> 1) SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM cloud c WHERE c.label = 5 AND c.id = k.id) UNION ALL SELECT * FROM cloud WHERE label = 5")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after an upsert of rows that changed, a delete and a compaction."""
    cloud, local = _replicas(spark, sf_dir)
    store = TableStore(spark, stages.folder(spark), ", ".join(f"{n} {t}" for n, t in local.dtypes))
    store.publish(local)
    store.upsert(cloud.filter("label = 5"))
    store.delete_where(F.col("label") == 1)
    store.compact()
    return store.read()


@_query(f"""WITH {_CHUNKS}, p AS (SELECT md5(source || '|' || page || '|' || substr(content, 1, 80)) AS hash, max_by(e.embedding, id) AS embedding FROM c JOIN embeddings e ON e.vec_id = c.id GROUP BY 1)
    SELECT c.id, p.embedding IS NOT NULL AS has_vector, coalesce(round(p.embedding[1]::DOUBLE, 6), 0) AS first FROM c LEFT JOIN p ON md5(source || '|' || page || '|' || substr(content, 1, 80)) = p.hash""")
def export_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    points = chunks.join(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    out = replicate.export(chunks, points)
    return out.select("id", F.col("embedding").isNotNull().alias("has_vector"), F.coalesce(F.round(F.col("embedding")[0].cast("double"), 6), F.lit(0.0)).alias("first"))


@_query("""SELECT md5(string_agg(h, ',' ORDER BY b)) AS etag FROM (SELECT substr(md5(vec_id::VARCHAR), 1, 3) AS b, md5(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id::VARCHAR)) AS h FROM embeddings GROUP BY 1)""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate.fingerprint(_table(spark, sf_dir, "embeddings"), "vec_id")


@_query(f"""WITH {_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_sources, count(DISTINCT parent_id) AS n_parents, count(embedding) AS n_vectors, max(len(embedding)) AS dimension FROM c LEFT JOIN embeddings ON vec_id = id""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return replicate.stats(_chunks(spark, sf_dir).join(points, "id", "left")).withColumn("dimension", F.col("dimension").cast("bigint"))


@_query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT u.conv_id, u.turn, row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY m.n) AS position, m.role, m.text FROM s u JOIN s m ON m.conv_id = u.conv_id AND m.n BETWEEN u.n - 3 AND u.n WHERE u.role = 'user'""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(_table(spark, sf_dir, "conversations"), max_turns=2)


@_query("""SELECT conv_id, turn, question, text AS answer FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations) WHERE role = 'assistant'""")
def last_user_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.question_before(_table(spark, sf_dir, "conversations"))


@_query("""WITH s AS (SELECT *, row_number() OVER o AS n, count(*) FILTER (role = 'assistant') OVER o AS a FROM conversations WHERE role IN ('user', 'assistant') WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
    SELECT d.conv_id, d.turn, string_agg(upper(substr(m.role, 1, 1)) || substr(m.role, 2) || ': ' || substr(m.text, 1, 200), chr(10) ORDER BY m.n) AS prompt
    FROM s d JOIN s m ON m.conv_id = d.conv_id AND m.n BETWEEN d.n - 9 AND d.n WHERE d.role = 'assistant' AND d.a % 2 = 0 GROUP BY d.conv_id, d.turn HAVING count(*) >= 4""")
def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summary_prompts(_table(spark, sf_dir, "conversations"), every=2)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of their source: a first line that others follow and that is short enough is a heading, of a level that the id tells; all else is text."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "text", F.substring_index("text", "\n", 1).alias("line"))
    head = F.coalesce((F.instr("text", "\n") > 0) & (F.length("line") < chunking.HEADING_LENGTH), F.lit(False))
    own = F.struct((F.col("doc_id") * 2).alias("ord"), F.lit("heading").alias("type"), (F.col("doc_id") % 3 + 1).cast("int").alias("level"), F.col("line").alias("content"))
    rest = F.when(head, F.expr("substring(text, length(line) + 2)")).otherwise(F.col("text"))
    text_ = F.struct((F.col("doc_id") * 2 + 1).alias("ord"), F.lit("text").alias("type"), F.lit(None).cast("int").alias("level"), rest.alias("content"))
    each = docs.select("source", F.floor(F.col("doc_id") / 50).cast("int").alias("page"), F.explode(F.when(head, F.array(own, text_)).otherwise(F.array(text_))).alias("b"))
    return each.select("source", "b.ord", "page", "b.type", "b.level", "b.content")


_BLOCK_SQL = """d AS (SELECT *, split_part(text, chr(10), 1) AS line, coalesce(strpos(text, chr(10)) > 0 AND length(split_part(text, chr(10), 1)) < 200, false) AS has_head FROM documents),
    b AS (SELECT source, doc_id * 2 AS ord, doc_id // 50 AS page, true AS head, doc_id % 3 + 1 AS level, line AS content FROM d WHERE has_head
        UNION ALL SELECT source, doc_id * 2 + 1, doc_id // 50, false, NULL, CASE WHEN has_head THEN substr(text, length(line) + 2) ELSE text END FROM d),
    l AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER o AS a1, max(CASE WHEN level = 2 THEN ord END) OVER o AS a2, max(CASE WHEN level = 3 THEN ord END) OVER o AS a3 FROM b WINDOW o AS (PARTITION BY source ORDER BY ord)),
    p AS (SELECT l.*, concat_ws(' > ', h1.content, h2.content, h3.content) AS section_path, coalesce(h3.content, h2.content, h1.content, '') AS heading
        FROM l LEFT JOIN b h1 ON h1.ord = l.a1 LEFT JOIN b h2 ON h2.ord = l.a2 AND l.a2 > coalesce(l.a1, -1) LEFT JOIN b h3 ON h3.ord = l.a3 AND l.a3 > coalesce(l.a1, -1) AND l.a3 > coalesce(l.a2, -1)),
    s AS (SELECT *, sum(CASE WHEN n = 1 THEN 0 WHEN head OR section_path IS DISTINCT FROM before OR page IS DISTINCT FROM page_before THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord) AS section
        FROM (SELECT *, row_number() OVER o AS n, lag(section_path) OVER o AS before, lag(page) OVER o AS page_before FROM p WINDOW o AS (PARTITION BY source ORDER BY ord)))"""


@_query(f"WITH {_BLOCK_SQL} SELECT source, ord, heading, section_path FROM p")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.outline(_blocks(spark, sf_dir), "ord").drop("section")


@_query(f"WITH {_BLOCK_SQL} SELECT source, ord, section::BIGINT AS section FROM s")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.outline(_blocks(spark, sf_dir), "ord").select("source", "ord", "section")


@_query(f"WITH {_BLOCK_SQL} SELECT CASE WHEN head THEN 'heading' ELSE 'text' END AS type, count(*) AS n FROM b GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.type_counts(_blocks(spark, sf_dir))


@_query("SELECT l_orderkey::VARCHAR AS source, list_sort(list(l_quantity))[count(*) // 2 + 1] AS body FROM lineitem GROUP BY l_orderkey")
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of a page: the upper median of their quantities."""
    spans = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), F.lit(1).alias("page"), F.col("l_quantity").alias("size"))
    return chunking.body_size(spans).select("source", "body")


@_query("SELECT count(*) AS n_chunks, round_even(avg(length(text)), 0)::BIGINT AS mean_length, min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(_table(spark, sf_dir, "documents").select(F.col("text").alias("content")))


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, {'round(min(' + c + ')::DOUBLE, 4)' if n else 'NULL::DOUBLE'} AS low, {'round(max(' + c + ')::DOUBLE, 4)' if n else 'NULL::DOUBLE'} AS high, {'round(avg(' + c + ')::DOUBLE, 4)' if n else 'NULL::DOUBLE'} AS mean FROM orders"
    for c, n in (("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderdate", 0), ("o_orderpriority", 0))
)


@_query(_PROFILE)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile(_table(spark, sf_dir, "orders"))


@_query("""SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 50)""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_markdown(_table(spark, sf_dir, "nation"), "n_nationkey")


@_query("""SELECT to_json(s)::VARCHAR AS json FROM (SELECT {'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey} AS s FROM customer)""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.json_rows(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))


@_query("""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 OR length(text) > 300 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) ELSE text END AS preview FROM documents""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@_query("""SELECT user_id, event_id, ts FROM (SELECT *, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type <> 'error' AND NOT before""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("online"))
    return sync.transitions(states, "user_id", "ts", "online", "event_id").select("user_id", "event_id", "ts")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and queries with vectors of the stand-in embedder."""
    own = keys.parent_id(F.col("source"), F.col("page"), F.col("section_path"), F.col("id"))
    chunks = _chunks(spark, sf_dir).withColumns({"parent_id": own, "parent_content": F.col("content"), "vector": models.embed(F.col("content"))})
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").withColumn("vector", models.embed(F.col("text"), query=True))
    return chunks, asked


@_query()
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir)[0].select("id", "vector")


@_query(
    f"""WITH RECURSIVE {_dense_sql('vec_id % 20 = 0', 'true', 60)}, c AS MATERIALIZED (SELECT query_id, vec_id, rank, e FROM dense JOIN v USING (vec_id)),
    near AS MATERIALIZED (SELECT a.query_id, a.rank, list(b.rank) AS likes FROM c a JOIN c b ON a.query_id = b.query_id AND b.rank < a.rank AND list_cosine_similarity(a.e, b.e) >= 0.7 GROUP BY ALL),
    n AS MATERIALIZED (SELECT query_id, rank, vec_id, coalesce(likes, []) AS likes FROM c LEFT JOIN near USING (query_id, rank)),
    walk AS (SELECT query_id, 0::BIGINT AS step, []::BIGINT[] AS taken FROM n GROUP BY query_id
        UNION ALL SELECT w.query_id, n.rank, CASE WHEN len(taken) < 20 AND NOT list_has_any(taken, likes) THEN list_append(taken, n.rank) ELSE taken END
        FROM walk w JOIN n ON n.query_id = w.query_id AND n.rank = w.step + 1),
    final AS (SELECT query_id, taken FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step DESC) = 1)
    SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT list_contains(taken, n.rank), n.rank) AS rank FROM n JOIN final USING (query_id)) WHERE rank <= 20"""
)
def diversity_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "embeddings")
    found = dense.top_k(points, points.filter("vec_id % 20 = 0"), 60)
    return fusion.diverse(found.join(points.select("vec_id", "embedding"), "vec_id"), "vec_id", "embedding", 20)


@_query(
    f"""WITH {_bm25_sql(20)}, o AS (SELECT item_id, list_distinct({_tokens_sql('text')}) AS asked FROM benchmark),
    r AS (SELECT item_id AS query_id, doc_id, round(score, 4) AS retrieval_score, rank AS old,
        CASE WHEN len(asked) > 0 THEN round(len(list_intersect(asked, tokens))::DOUBLE / len(asked), 4) ELSE 0 END AS rerank_score FROM bm25 JOIN o USING (item_id) JOIN d USING (doc_id))
    SELECT * EXCLUDE (old) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM r) WHERE rank <= 5"""
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = lexical.bm25(docs, asked, 20).withColumnRenamed("item_id", "query_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    found = found.join(asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    return fusion.rerank(found, models.overlap(F.col("question"), F.col("content")), 5).select("query_id", "doc_id", "retrieval_score", "rerank_score", "rank")


@_query()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.hybrid(*_vectors(spark, sf_dir)).select("query_id", "id", "score", "rank")


@_query()
def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _vectors(spark, sf_dir)
    return retrieve.prompts(retrieve.answer_passages(chunks, asked), asked)


@_query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunker("recursive")(chunking.breadcrumbs(_blocks(spark, sf_dir), "ord", numbered=True), "ord")


#: Lines gathered to chunks, told by the numbers of their first and last line; ``c`` has the lengths of all lines before one.
_FIXED = r"""k AS MATERIALIZED (SELECT ord, page, source, CASE WHEN head THEN 'heading' ELSE 'text' END AS type, heading, section_path, [x FOR x IN string_split(content, chr(10)) IF x <> ''] AS w FROM p WHERE content IS NOT NULL),
    z AS MATERIALIZED (SELECT *, len(w) AS n, [coalesce(list_sum([length(x) FOR x IN w[1:i]]), 0)::BIGINT FOR i IN range(0, len(w) + 1)] AS c FROM k),
    walk AS (SELECT ord, 1::BIGINT AS i, 1::BIGINT AS s, NULL::BIGINT AS a, NULL::BIGINT AS b FROM z WHERE n > 0
        UNION ALL SELECT ord, i + 1, CASE WHEN full_ THEN coalesce(list_min([j FOR j IN range(s + 1, i) IF c[i] - c[j] + i - j - 1 <= 50 AND c[i + 1] - c[j] + i - j <= 500]), i) ELSE s END, CASE WHEN full_ THEN s END, CASE WHEN full_ THEN i - 1 END
            FROM (SELECT walk.ord, i, s, c, s < i AND c[i + 1] - c[s] + i - s > 500 AS full_ FROM walk JOIN z USING (ord) WHERE i <= n)),
    told AS (SELECT ord, a, b FROM walk WHERE a IS NOT NULL UNION ALL SELECT z.ord, s, n FROM walk JOIN z USING (ord) WHERE i = n + 1 AND s <= n),
    said AS (SELECT z.*, a, regexp_replace(array_to_string(w[a:b], chr(10)), '^\s+|\s+$', '', 'g') AS content FROM told JOIN z USING (ord))"""


@_query(f"""WITH RECURSIVE {_BLOCK_SQL}, {_FIXED} SELECT content, page::INTEGER AS page, type, source, heading, section_path, NULL::VARCHAR AS parent_content, NULL::VARCHAR AS parent_id,
    (row_number() OVER (PARTITION BY ord ORDER BY a) - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY ord))::INTEGER AS total_chunks, 'fixed' AS strategy FROM said WHERE content <> ''""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunker("fixed")(chunking.breadcrumbs(_blocks(spark, sf_dir), "ord", numbered=True), "ord")


@_query()
def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunker("hierarchical")(chunking.breadcrumbs(_blocks(spark, sf_dir), "ord", numbered=True), "ord")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark item."""
    return lexical.bm25(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 5)
