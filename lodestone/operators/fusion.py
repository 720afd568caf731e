"""Fusing, thinning and reordering ranked passages; every table is keyed by ``query_id`` and has an explicit rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
LIKE = 0.70


def rrf(dense: DataFrame, sparse: DataFrame, key: str, k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``query_id, key, rrf_score, rank`` of two legs (``query_id, key, rank``), by weighted reciprocal ranks.

    Equal scores follow the dense rank, then the sparse one. Duplicates within a leg add up.
    """
    legs = [leg.select("query_id", key, F.col("rank").alias("r"), F.lit(i).alias("leg"), (w / (k + F.col("rank"))).alias("part")) for i, (leg, w) in enumerate(zip((dense, sparse), weights))]
    rank = lambda i: F.min(F.when(F.col("leg") == i, F.col("r")))
    fused = legs[0].unionByName(legs[1]).groupBy("query_id", key).agg(F.sum("part").alias("score"), rank(0).alias("dense_rank"), rank(1).alias("sparse_rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), key)
    return fused.select("query_id", key, F.round("score", 6).alias("rrf_score"), F.row_number().over(order).cast("bigint").alias("rank"))


def above(ranked: DataFrame, score: str, least: float) -> DataFrame:
    """Rows whose (rounded) score reaches ``least``; 0 keeps all."""
    return ranked.filter(F.col(score) >= least) if least > 0 else ranked


def best_of(ranked: DataFrame, *by: str | Column) -> DataFrame:
    """For each query and key the row of best rank."""
    order = Window.partitionBy("query_id", *by).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def renumbered(ranked: DataFrame, *order: str | Column) -> DataFrame:
    """``ranked`` with ranks from 1, by ``order`` (default: as ranked)."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*(order or ("rank",)))).cast("bigint"))


def expand_to_parents(ranked: DataFrame) -> DataFrame:
    """Each passage's parent in its place, once for each parent; passages without a parent or its text stay as they are."""
    own = (F.coalesce("parent_id", F.lit("")) == "") | (F.coalesce("parent_content", F.lit("")) == "")
    key = F.when(own, F.concat(F.lit("\u0000"), F.col("rank").cast("string"))).otherwise(F.col("parent_id"))
    first = best_of(ranked.withColumn("_key", key), "_key").drop("_key")
    return renumbered(first.withColumn("content", F.when(own, F.col("content")).otherwise(F.col("parent_content"))))


def rerank(ranked: DataFrame, score: Column, k: int, least: float | None = None) -> DataFrame:
    """The ``k`` rows of highest ``score`` (4 places), ties as ranked before; the old score is kept as ``retrieval_score``."""
    scored = ranked.withColumns({"retrieval_score": F.col("score"), "rerank_score": F.round(score, 4)})
    if least is not None:
        scored = scored.filter(F.col("rerank_score") >= least)
    return renumbered(scored, F.col("rerank_score").desc(), "rank").filter(F.col("rank") <= k)


def diverse(ranked: DataFrame, key: str, vector: str, k: int, like: float = LIKE) -> DataFrame:
    """At most ``k`` rows a query: in rank order, those less than ``like`` to all taken before; then rejected ones fill up.

    ``query_id, key, rank``. A query with ``k`` candidates or fewer keeps all. The fold runs over one query's candidates, which
    the search before has bounded; only their vectors are carried.
    """
    from lodestone.functions.vectors import cosine

    each = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("id"), F.col(vector).alias("v")))).alias("c"))
    element = each.schema["c"].dataType.simpleString()

    def step(taken: Column, x: Column) -> Column:
        room = (F.size(taken) < k) & ~F.exists(taken, lambda t: cosine(t["v"], x["v"]) >= like)
        return F.when(room, F.concat(taken, F.array(x))).otherwise(taken)

    taken = F.aggregate("c", F.expr(f"cast(array() as {element})"), step)
    each = each.withColumn("t", F.transform(taken, lambda x: x["rank"])).withColumn("left", F.filter("c", lambda x: ~F.array_contains(F.col("t"), x["rank"])))
    picked = F.slice(F.concat(F.filter("c", lambda x: F.array_contains(F.col("t"), x["rank"])), F.col("left")), 1, k)
    picked = F.when(F.size("c") <= k, F.col("c")).otherwise(picked)
    return each.select("query_id", F.posexplode(picked).alias("pos", "x")).select("query_id", F.col("x.id").alias(key), (F.col("pos") + 1).cast("bigint").alias("rank"))
