"""Hybrid retrieval: vector and keyword hits merged by chunk, normalised within the query, scored by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T


def min_max(value: Column, window, reverse: bool = False) -> Column:
    """Scaled to 0..1 within the window, more is better; 1 where all agree; null stays null."""
    v = -value if reverse else value
    low, high = F.min(v).over(window), F.max(v).over(window)
    return F.when(v.isNull(), None).when(high == low, F.lit(1.0)).otherwise((v - low) / (high - low))


def merge(semantic: DataFrame, keyword: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits of either arm with their chunk and document; hits whose chunk or document is missing are dropped.

    semantic: query_id, chunk_id, score. keyword: query_id, chunk_id, bm25, term. chunks: chunk_id, document_id, text.
    documents: document_id, document_name, document_type.
    """
    both = semantic.select("query_id", "chunk_id", F.col("score").alias("semantic")).join(
        keyword.select("query_id", "chunk_id", F.col("bm25").alias("keyword"), "term"), ["query_id", "chunk_id"], "full_outer"
    )
    return both.join(chunks.select("chunk_id", "document_id", "text"), "chunk_id").join(
        documents.select("document_id", "document_name", "document_type"), "document_id"
    )


def rerank(hits: DataFrame, queries: DataFrame, top_k: int = V.TOP_CANDIDATES, weights: dict[str, float] = V.WEIGHTS) -> DataFrame:
    """Documents by weighted score, top_k a query, with their evidence (chunk ids, best first, top_k of them).

    queries: query_id, identifiers, attributes, priority_types (arrays of strings).
    """
    per_query = Window.partitionBy("query_id")
    rows = hits.join(queries.select("query_id", "identifiers", "attributes", "priority_types"), "query_id")
    rows = rows.withColumn("ns", min_max(F.col("semantic"), per_query)).withColumn("nk", min_max(F.col("keyword"), per_query, reverse=True))
    strength = F.coalesce("ns", F.lit(0.0)) + F.coalesce("nk", F.lit(0.0))
    rows = rows.select(
        "query_id", "document_id", "document_name", "chunk_id", "text", "semantic", "keyword", "term", "ns", "nk", strength.alias("strength"),
        F.array_contains("priority_types", F.col("document_type")).alias("typed"),
        T.contains_any(F.col("text"), F.col("identifiers")).alias("identified"),
        T.contains_any(F.col("text"), F.filter("attributes", lambda a: F.length(a) > 0)).alias("matched"),
    )
    # the cut comes first: of each document only top_k texts are carried on
    place = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(F.desc("strength"), "chunk_id"))
    kept = lambda c: F.when(F.col("place") <= top_k, F.col(c))
    rows = rows.withColumn("place", place).withColumn("text", kept("text"))
    gate = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    by_doc = rows.groupBy("query_id", "document_id", "document_name").agg(
        F.coalesce(F.max("ns"), F.lit(0.0)).alias("ns"), F.coalesce(F.max("nk"), F.lit(0.0)).alias("nk"),
        F.max("semantic").alias("semantic_score"), F.min("keyword").alias("keyword_score"),
        gate("typed").alias("document_type_boost"), gate("identified").alias("exact_identifier_boost"), gate("matched").alias("profile_attribute_boost"),
        F.array_sort(F.collect_set("term")).alias("matched_terms"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= top_k, F.struct("place", "chunk_id", "text")))).alias("evidence"),
    )
    score = (
        weights["semantic"] * F.col("ns") + weights["keyword"] * F.col("nk") + weights["document_type"] * F.col("document_type_boost")
        + weights["identifier"] * F.col("exact_identifier_boost") + weights["attribute"] * F.col("profile_attribute_boost")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "document_id")
    by_doc = by_doc.withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["text"].alias("text"))))
    return by_doc.withColumn("final_score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
