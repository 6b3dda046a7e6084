"""Fusion of ranked lists, re-ranking and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import occurrences, strip

RRF_K = 60


def fuse(lists: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank) of ranked lists (query_id, id, rank): the sum of 1 / (rrf_k + rank), best first, then by
    the first list and the rank in it, then by id."""
    rows = None
    for n, ranked in enumerate(lists):
        part = ranked.select("query_id", "id", F.lit(n).alias("list_no"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    score = F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 6).alias("score")
    fused = rows.groupBy("query_id", "id").agg(score, F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def preview(path, symbol, signature, body, most: int = 2000):  # noqa: ANN001, ANN201
    """What a re-ranker reads of a chunk."""
    head = strip(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(symbol, F.lit("")), F.coalesce(signature, F.lit(""))))
    return F.substring(F.concat(head, F.lit("\n"), F.coalesce(body, F.lit(""))), 1, most)


def word_hits(query: Column, text: Column) -> Column:
    """The stand-in of a cross-encoder: how often the query's words stand in the text, in lower case."""
    return occurrences(F.lower(text), F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))


def rerank(candidates: DataFrame, k: int, score: Callable[[Column, Column], Column] = word_hits) -> DataFrame:
    """(query_id, id, score, rank) of candidates (query_id, id, rank, query, text) by ``score`` of query and text, such as a
    model's pandas UDF; the earlier rank is first among equals."""
    scored = candidates.withColumn("score", score(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order).cast("long")).where(F.col("new_rank") <= k).select("query_id", "id", "score", F.col("new_rank").alias("rank"))


def evaluate(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row (cases, mrr, recall) at ``k`` of (query_id, file, symbol, rank) against (query_id, file, symbol); an expected
    symbol of null means any."""
    e = expected.select("query_id", F.col("file").alias("want_file"), F.col("symbol").alias("want_symbol"))
    hit = ranked.where(F.col("rank") <= k).join(e, "query_id").where("file = want_file and (want_symbol is null or symbol = want_symbol)")
    best = hit.groupBy("query_id").agg(F.min("rank").alias("best"))
    joined = expected.select("query_id").join(best, "query_id", "left")
    return joined.agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("best").isNotNull().cast("double")), 6).alias("recall"),
    )
