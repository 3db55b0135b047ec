"""Queries of the training-data operators (problems 1, 3, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.leaks import find_leaks, remove_leaks
from newsloom.llm.packing import pack
from newsloom.llm.rrf import reciprocal_rank_fusion
from newsloom.llm.stuffing import stuffing
from newsloom.llm.tokens import token_counts
from newsloom.llm.topn import top_n
from newsloom.session import table

SCORES = ("bm25_score", "semantic_score", "fusion_score")
KEYS = ("impression_id", "candidate_article_id")


def _top5(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "candidate_features"), *KEYS, "reranker_score", 5, position="candidate_position", version="scored_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _top5(spark, d).select(*KEYS)


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top5(spark, d).select(*KEYS, F.round("reranker_score", 6).alias("reranker_score"), "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return reciprocal_rank_fusion(table(spark, d, "candidate_features"), *KEYS, SCORES, position="candidate_position", version="scored_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    wins = sum((F.when(F.col(f"rank_{s}") == 1, 1).otherwise(0) for s in SCORES), F.lit(0))
    return _fused(spark, d).where((wins >= 2) & (F.col("top_sum") > F.col("plain_sum"))).select(*KEYS)


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select(*KEYS, *[f"rank_{s}" for s in SCORES], F.round("rrf_score", 6).alias("rrf_score"), "position")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", capacity=2048)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumn("item_share", F.round("item_share", 6))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    out = remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return out.select("doc_id", "text", "removed_words", "dropped")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing(table(spark, d, "documents")).where("is_stuffed").select("doc_id")


def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    return stuffing(table(spark, d, "documents")).select("doc_id", *[F.round(c, 6).alias(c) for c in ("links", "repeated", "no_clause", "stuffed")], "is_stuffed")


QUERIES = {f.__name__: f for f in (p1_found, p1_ranked, p3_found, p3_fused, p7_packed, p8_found, p8_report, p8_cleaned, p9_found, p9_figures)}

_LATEST = """
WITH v AS (SELECT impression_id, candidate_article_id, candidate_position, scored_at,
    CASE WHEN isnan(reranker_score) THEN NULL ELSE reranker_score END reranker_score,
    CASE WHEN isnan(bm25_score) THEN NULL ELSE bm25_score END bm25_score,
    CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END semantic_score,
    CASE WHEN isnan(fusion_score) THEN NULL ELSE fusion_score END fusion_score
  FROM candidate_features WHERE impression_id IS NOT NULL AND candidate_article_id IS NOT NULL),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY impression_id, candidate_article_id ORDER BY scored_at DESC NULLS LAST, {order}, candidate_position ASC NULLS LAST) = 1)
"""
_TOP = _LATEST.format(order="reranker_score DESC NULLS LAST") + "SELECT impression_id, candidate_article_id{more} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY reranker_score DESC, candidate_position ASC NULLS LAST, candidate_article_id) AS INTEGER) rank FROM l WHERE reranker_score IS NOT NULL) WHERE rank <= 5"
_RANKS = (
    _LATEST.format(order=", ".join(f"{s} DESC NULLS LAST" for s in SCORES))
    + ", r AS (SELECT *, "
    + ", ".join(f"CASE WHEN {s} IS NOT NULL THEN count(*) OVER (PARTITION BY impression_id ORDER BY {s} DESC NULLS LAST RANGE UNBOUNDED PRECEDING) END rank_{s}" for s in SCORES)
    + ", " + " + ".join(f"coalesce({s}, 0)" for s in SCORES) + " plain_sum FROM l), "
    + "f AS (SELECT *, max(plain_sum) OVER (PARTITION BY impression_id) top_sum, round(" + " + ".join(f"coalesce(1.0 / (rank_{s} + 60), 0.0)" for s in SCORES) + ", 12) rrf FROM r) "
)
SQL = {
    "p1_found": _TOP.format(more=""),
    "p1_ranked": _TOP.format(more=", round(reranker_score, 6) reranker_score, rank"),
    "p3_found": _RANKS + "SELECT impression_id, candidate_article_id FROM f WHERE top_sum > plain_sum AND " + " + ".join(f"CAST(coalesce(rank_{s} = 1, false) AS INTEGER)" for s in SCORES) + " >= 2",
    "p3_fused": _RANKS + "SELECT impression_id, candidate_article_id, " + ", ".join(f"rank_{s}" for s in SCORES) + ", round(rrf, 6) rrf_score, row_number() OVER (PARTITION BY impression_id ORDER BY rrf DESC, candidate_position ASC NULLS LAST, candidate_article_id) AS position FROM f",
}
