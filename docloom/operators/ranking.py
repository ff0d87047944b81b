"""Fusion of channels, document aggregation, deduplication, decay and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """hits (query_id, channel, id, rank) -> rrf_score, channels, fused_rank per query and id.

    A channel without a positive weight counts with weight 1."""
    w: Column = F.lit(1.0)
    for name, value in (weights or {}).items():
        if value > 0:
            w = F.when(F.col("channel") == name, F.lit(float(value))).otherwise(w)
    fused = hits.groupBy("query_id", "id").agg(
        F.sum(w / (k + F.col("rank"))).alias("rrf_score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def score_fusion(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """hits (query_id, channel, id, score) -> score: each channel's scores at 0 to 1 within their query, times
    the channel's weight. Where all scores of a channel are the same they count as 1."""
    ends = hits.groupBy("query_id", "channel").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("channel") == name, F.lit(value)).otherwise(w)
    level = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return hits.join(ends, ["query_id", "channel"]).groupBy("query_id", "id").agg(F.sum(w * level).alias("score"))


def by_document(chunks: DataFrame, per_document: int = 3) -> DataFrame:
    """(query_id, document_id, chunk_index, score) -> total score, best chunks, relevance 0..100.

    Relevance is the share of the query's best total, one decimal, rounded half up."""
    w = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_index")
    best = chunks.withColumn("r", F.row_number().over(w))
    docs = best.groupBy("query_id", "document_id").agg(
        F.sum("score").alias("total"),
        F.count("*").alias("n_chunks"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= per_document, F.struct("r", "chunk_index")))), lambda s: s["chunk_index"].cast("string"))).alias("top_chunks"),
    )
    top = docs.groupBy("query_id").agg(F.max("total").alias("__top"))
    return docs.join(top, "query_id").withColumn("relevance", F.floor(F.col("total") / F.col("__top") * 1000 + 0.5) / 10).drop("__top")


def dedupe_prefix(chunks: DataFrame, size: int = 200) -> DataFrame:
    """Of a document's chunks with one prefix the best is kept, then the first."""
    w = Window.partitionBy("document_id", F.left("content", F.lit(size))).orderBy(F.desc("score"), "chunk_index")
    return chunks.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def recency(score: Column, age_days: Column, days: float = 30.0) -> Column:
    """Half at ``days``: score / (1 + age / days); an unknown age changes nothing."""
    return F.when(age_days.isNull(), score).otherwise(score / (1 + age_days / days))


def exponential(score: Column, age_days: Column, days: float = 30.0) -> Column:
    return score * F.exp(-age_days / days)


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by the reranker's score, missing ones last, then by the fused score, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("reranked"), F.desc("rrf_score"), "id")
    return hits.join(scores, ["query_id", "id"], "left").withColumn("final_rank", F.row_number().over(w))


def final_score(reranked: Column, raw: Column, fused: Column) -> Column:
    return F.when(reranked.isNotNull(), reranked).when(raw > 0, raw).otherwise(fused * 100)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """precision@k, recall@k, reciprocal rank and nDCG@k per query of ``relevant`` (query_id, id)."""
    hit = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi")
    got = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    base = relevant.groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return base.join(got, "query_id", "left").select(
        "query_id", z(F.col("hits") / k).alias("precision"), z(F.col("hits") / F.col("n")).alias("recall"), z(1 / F.col("first")).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg")
    )


def permute(hits: DataFrame, orders: DataFrame) -> DataFrame:
    """Reorder hits (query_id, id, rank from 1) by ``orders`` (query_id, order: zero-based places).

    Places that repeat or do not exist are passed over; hits that are not listed follow in their order."""
    listed = orders.select("query_id", F.posexplode("order").alias("__p", "__i")).groupBy("query_id", (F.col("__i") + 1).alias("rank")).agg(F.min("__p").alias("__p"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("__p"), "rank")
    return hits.join(listed, ["query_id", "rank"], "left").withColumn("final_rank", F.row_number().over(w)).drop("__p")
