"""Reciprocal rank fusion of rankings, and the fused hits' chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

RANKED = 12
K, TOP = 60, 5


def fused(vectors: DataFrame, keywords: DataFrame, k: int = K, top: int = TOP) -> DataFrame:
    """(query_id, chunk_id, vec_rank, bm25_rank, rrf_score, fused_rank): the `top` hits; ties by the vector rank, then the keyword rank; an absent rank is -1."""
    ranks = vectors.select("query_id", "chunk_id", "vec_rank", F.lit(None).cast("int").alias("bm25_rank")).unionByName(keywords.select("query_id", "chunk_id", F.lit(None).cast("int").alias("vec_rank"), "bm25_rank"))
    both = ranks.groupBy("query_id", "chunk_id").agg(F.max("vec_rank").alias("vec_rank"), F.max("bm25_rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part("vec_rank") + part("bm25_rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", RANKED).desc(), F.col("vec_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    best = scored.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= top)
    return best.select("query_id", "chunk_id", F.coalesce("vec_rank", F.lit(-1)).alias("vec_rank"), F.coalesce("bm25_rank", F.lit(-1)).alias("bm25_rank"), "rrf_score", "fused_rank")


def fused_rankings(rankings: list[DataFrame], k: int = K, top: int = TOP) -> DataFrame:
    """(query_id, chunk_id, rrf_score, fused_rank) of any number of rankings (query_id, chunk_id, rank); ties by first appearance."""
    numbered = [r.select("query_id", "chunk_id", "rank", F.lit(i).alias("source")) for i, r in enumerate(rankings)]
    all_ = reduce(DataFrame.unionByName, numbered)
    scored = all_.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("source", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", RANKED).desc(), "first")
    return scored.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= top).drop("first")


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with document, title, path and page_id; a chunk that isn't stored has an empty document. The chunks are cut down to the hits' first. The hits are written once (a Spark job), so that a search isn't run for each use of them and few of them are broadcast rather than all chunks shuffled."""
    hits = written(hits, "hits")
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "document", "title", "path", "page_id")
    return hits.join(wanted, "chunk_id", "left").withColumn("document", F.coalesce("document", F.lit("")))
