"""BM25 over a table of texts: an index, derived statistics and top passages for a table of queries.

The index holds each document's tokens with their counts, made where the document is read, and the vocabulary. It is stored once; a search
reads nothing else. The terms of a query set of bounded size go to every task and documents stream past them; those of a larger one meet the
postings in a join, in which each token is split by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import batches as held
from lodestone.functions import text
from lodestone.operators import ranking
from lodestone.operators.stages import stored

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Query terms that every task may hold.
MOST_TERMS = 200_000
#: Hits scored at a time, and parts of a token's postings in the join.
HITS, PARTS = 1 << 20, 64


@dataclass(frozen=True)
class Index:
    """``terms``: ``doc, dl, terms`` (token, tf); ``vocabulary``: ``token, df, idf``; the number of documents and their mean length."""

    terms: DataFrame
    vocabulary: DataFrame
    n_docs: int
    avgdl: float

    def save(self, path: str) -> None:
        """Writes the index to ``path``, which must not exist; readers of an older one go on with theirs."""
        self.terms.write.parquet(f"{path}/terms")
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        self.terms.sparkSession.createDataFrame([(self.n_docs, self.avgdl)], "n_docs bigint, avgdl double").coalesce(1).write.parquet(f"{path}/size")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/vocabulary"), *spark.read.parquet(f"{path}/size").first())


def counted(docs: DataFrame, key: str, content: str) -> DataFrame:
    """``doc, dl, terms``: each document's tokens with their counts, by sorting them within the row."""
    rows = docs.select(F.col(key).alias("doc"), F.sort_array(text.tokenize(F.col(content))).alias("s")).withColumn("dl", F.size("s"))
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.col("dl") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.withColumn("a", starts)
    ends = F.concat(F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))), F.array("dl"))
    terms = F.when(F.col("dl") > 0, F.zip_with("a", ends, lambda a, b: F.struct(F.get("s", a).alias("token"), (b - a).alias("tf")))).otherwise(F.array().cast("array<struct<token:string,tf:int>>"))
    return rows.select("doc", "dl", terms.alias("terms"))


def build(docs: DataFrame, key: str = "doc_id", content: str = "text") -> Index:
    """Tokenises ``docs`` once. A table of fewer files than there are cores is spread first, as making tokens outweighs moving so little."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(key, content)
    terms = stored(counted(docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs, key, content))
    n, total = terms.agg(F.count(F.lit(1)), F.sum("dl")).first()
    df = terms.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return Index(terms, stored(_with_idf(df, n)), n, (total or 0) / n if n else 0.0)


def _with_idf(df: DataFrame, n: int) -> DataFrame:
    """``token, df, idf``: a negative idf is replaced by a share of the mean idf of all tokens."""
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((FLOOR * F.avg("raw")).alias("floor"))
    # One row, so the broadcast does not grow.
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def postings(docs: DataFrame, key: str, content: str) -> DataFrame:
    """``key, token, tf, dl`` of every document. One pass: a document's tokens are counted where it is read."""
    tokens = docs.select(F.col(key), text.tokenize(F.col(content)).alias("tokens")).select(key, "tokens", F.size("tokens").alias("dl"))
    return tokens.select(key, "dl", F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, content: str) -> DataFrame:
    """One row: ``n_docs``, and the mean length ``avgdl``; documents without tokens count."""
    return docs.select(F.size(text.tokenize(F.col(content))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(docs: DataFrame, content: str) -> DataFrame:
    """``token, df, idf`` of a table of texts."""
    each = docs.select(F.explode(F.array_distinct(text.tokenize(F.col(content)))).alias("token"))
    return _with_idf(stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))), docs.count())


def query_terms(queries: DataFrame, key: str, content: str) -> DataFrame:
    """``key, token, times``: a token counts as often as the query has it."""
    each = queries.select(key, F.explode(text.tokenize(F.col(content))).alias("token"))
    return each.groupBy(key, "token").agg(F.count(F.lit(1)).alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "item_id", content: str = "text") -> DataFrame:
    """``query_key, doc_key, score, rank``: for each query the ``k`` best documents of positive score, ties by document."""
    return search(build(docs, doc_key, content), queries, k, doc_key, query_key, content)


def search(index: Index, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "item_id", content: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """``query_key, doc_key, score, rank`` from an index. Only documents that share a token with a query are scored."""
    asked = query_terms(queries, query_key, content).join(index.vocabulary, "token")
    asked = asked.select(F.col(query_key).alias("query"), "token", "df", (F.col("times") * F.col("idf")).alias("weight"))
    held.bounded(asked.sparkSession)
    few = asked.limit(most_terms + 1).toArrow()
    if few.num_rows <= most_terms:
        types = (df.schema[c].dataType.simpleString() for df, c in ((asked, "query"), (index.terms, "doc")))
        found = index.terms.mapInArrow(_passed(few, index.avgdl, k), ranking.candidates(*types))
    else:
        found = _joined(index, asked).filter("score > 0")
    return ranking.ranked(found, k, query_key, doc_key)


def saturated(tf, dl, avgdl: float):
    """How much a token counts in a document, as numbers or as columns."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _passed(asked: pa.Table, avgdl: float, k: int):
    """Scores of the documents that pass by."""
    tokens = pc.unique(asked.column("token"))
    token = pc.index_in(asked.column("token"), value_set=tokens).to_numpy()
    queries = pc.unique(asked.column("query"))
    query = pc.index_in(asked.column("query"), value_set=queries).to_numpy()
    order = np.argsort(token, kind="stable")
    query, weight = query[order], asked.column("weight").to_numpy()[order]
    first = np.searchsorted(token[order], np.arange(len(tokens) + 1))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = ranking.Best(queries, k)
        for batch in batches if len(queries) else ():
            lists, dl = batch.column("terms"), batch.column("dl").to_numpy()
            flat = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = pc.fill_null(pc.index_in(flat.field("token"), value_set=tokens), -1).to_numpy()
            some = np.flatnonzero(at >= 0)
            at, doc = at[some], doc[some]
            value = saturated(flat.field("tf").to_numpy()[some], dl[doc], avgdl)
            n = first[at + 1] - first[at]
            # Whole documents, as many as have about so many hits.
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            hits = np.concatenate(([0], np.cumsum(n)))[cut]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(hits, hits[a] + HITS, side="right")) - 1)
                part = slice(cut[a], cut[b])
                m = n[part]
                entry = np.repeat(first[at[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield best.hits(batch.column("doc").slice(a, b - a), query[entry], np.repeat(doc[part] - a, m), np.repeat(value[part], m) * weight[entry])
                a = b
        held.give_back()

    return passed


def _joined(index: Index, asked: DataFrame) -> DataFrame:
    """Scores by a join of postings with query terms. A token's postings are dealt to ``PARTS`` by document, and its query terms go to each part."""
    terms = asked.drop("df").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    each = index.terms.select("doc", "dl", F.explode("terms").alias("t"), F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int").alias("part"))
    value = saturated(F.col("t.tf"), F.col("dl"), index.avgdl)
    scored = each.select("doc", "t.token", "part", value.alias("value")).join(terms, ["token", "part"])
    return scored.groupBy("query", F.col("doc").alias("point")).agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
