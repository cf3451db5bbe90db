"""Dense search, blending with BM25 and reranking for batches of queries.

The collection is scored against queries in blocks that are broadcast; a block is bounded by its number of vectors. The best k are
kept per task before the shuffle (row_number limits are pushed below the exchange).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.vector import dot, l2_normalize

QUERIES_PER_BLOCK = 2000


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """Queries in parts small enough to broadcast."""
    n = -(-queries.count() // QUERIES_PER_BLOCK)
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def knn(queries: DataFrame, rows: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, distance, similarity, rank) of the k nearest rows; queries(query_id, q_vec), rows(id, vec). A filter on the rows
    applies before the ranking. Similarity is rounded to 4 places; ties go to the smaller id."""
    if where is not None:
        rows = rows.where(where)
    unit = rows.where("vec is not null").select("id", l2_normalize(F.col("vec")).alias("vec"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    parts = []
    for block in query_blocks(queries):
        asked = F.broadcast(block.where("q_vec is not null").select("query_id", l2_normalize(F.col("q_vec")).alias("q_vec")))
        scored = unit.crossJoin(asked).select("query_id", "id", F.round(1 - dot(F.col("q_vec"), F.col("vec")), 9).alias("distance"))
        parts.append(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("similarity", F.round(1 - F.col("distance"), 4))


def mmr(candidates: DataFrame, k: int, weight: float = SETTINGS.mmr_lambda) -> DataFrame:
    """(query_id, id, mmr_rank): greedy choice of k candidates by relevance less redundancy.

    candidates(query_id, id, rank, vec, relevance). With fewer than k candidates they stay in rank order; ties go to the earlier candidate.
    The choice is a fold over each query's candidate array, at most ``fetch_k`` long."""
    packed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", F.col("relevance").cast("double").alias("relevance"), "vec"))).alias("c"))
    item = packed.schema["c"].dataType.simpleString()

    def step(chosen: Column, _: Column) -> Column:
        free = F.filter("c", lambda x: ~F.exists(chosen, lambda y: y["rank"] == x["rank"]))
        redundancy = lambda x: F.when(F.size(chosen) == 0, F.lit(0.0)).otherwise(
            F.array_max(F.transform(chosen, lambda y: dot(x["vec"], y["vec"]))))
        ranked = F.transform(free, lambda x: F.struct(
            F.round(-(F.lit(weight) * x["relevance"] - F.lit(1 - weight) * redundancy(x)), 9).alias("s"), x["rank"].alias("r"), x.alias("x")))
        return F.array_append(chosen, F.array_min(ranked)["x"])

    empty = F.array().cast(item)
    picked = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size("c"))), empty, step)
    kept = F.when(F.size("c") >= k, picked).otherwise(F.col("c"))
    return (packed.select("query_id", F.posexplode(kept).alias("p", "x"))
            .select("query_id", F.col("x.id").alias("id"), (F.col("p") + 1).alias("mmr_rank")))


def blend(dense: DataFrame, sparse: DataFrame, weight: float = SETTINGS.dense_weight) -> DataFrame:
    """Dense candidates with their BM25 score, 0 without one; hits of BM25 alone are not added."""
    joined = dense.join(sparse.select("query_id", "id", "bm25"), ["query_id", "id"], "left").fillna(0.0, ["bm25"])
    mixed = F.round(F.lit(weight) * F.col("similarity") + F.lit(1 - weight) * F.col("bm25"), 4)
    return joined.withColumn("score", F.when(F.col("bm25") > 0, mixed).otherwise(F.col("similarity")))


def rrf(*rankings: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings(query_id, id, rank). An extension."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank") for r in rankings])
    return every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))


def hybrid(queries: DataFrame, rows: DataFrame, sparse: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(query_id, position, id, similarity, bm25, score): candidates by vector, reranked by MMR, blended with BM25; MMR's order stays."""
    near = knn(queries, rows, settings.fetch_k)
    with_vec = near.join(rows.select("id", l2_normalize(F.col("vec")).alias("vec")), "id")
    order = mmr(with_vec.withColumn("relevance", F.col("similarity")), settings.top_k, settings.mmr_lambda)
    chosen = near.join(order, ["query_id", "id"])
    return blend(chosen, sparse, settings.dense_weight).select(
        "query_id", F.col("mmr_rank").alias("position"), "id", "similarity", "bm25", "score")
