"""Ranking metrics by windowed aggregates. An undefined metric is NULL, never NaN."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.vectors import reduce_lists


def impression_metrics(df: DataFrame, score: str, keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """``auc, mrr, ndcg5, ndcg10`` per group of (keys). Needs label, pos and the score.

    auc by rank sums with mean ranks for ties (NULL without a positive or a negative); mrr is the
    mean over all clicks of 1/rank; ndcg has gains 1/log2(rank + 1). Ranks are by score, ties by
    position. Rows with NULL label don't count.
    """
    d = df.where("label IS NOT NULL").withColumn("__s", F.col(score))
    g = W.partitionBy(*keys)
    asc = g.orderBy("__s")
    tied = W.partitionBy(*keys, "__s")
    d = d.withColumn("__a", F.rank().over(asc) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)
    d = d.withColumn("__r", F.row_number().over(g.orderBy(F.col("__s").desc_nulls_last(), "pos")))
    y = F.col("label").cast("double")
    gain = y / F.log2(F.col("__r") + 1.0)
    at = lambda k: F.sum(F.when(F.col("__r") <= k, gain).otherwise(0.0))
    a = d.groupBy(*keys).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") == 1, F.col("__a")).otherwise(0.0)).alias("ra"), F.sum(y / F.col("__r")).alias("rr"), at(5).alias("d5"), at(10).alias("d10"))
    p, neg = F.col("p"), F.col("n") - F.col("p")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(p.cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    ok = p > 0
    return a.select(
        *keys, F.when(ok & (neg > 0), (F.col("ra") - p * (p + 1) / 2.0) / F.when(ok & (neg > 0), p * neg)).alias("auc"), F.when(ok, F.col("rr") / F.when(ok, p)).alias("mrr"),
        F.when(ok, F.col("d5") / F.when(ok, ideal(5))).alias("ndcg5"), F.when(ok, F.col("d10") / F.when(ok, ideal(10))).alias("ndcg10"),
    )


def diversity(top: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """``keys, diversity``: 1 - mean pairwise cosine of the listed articles' unit vectors, from sums of
    vectors (no pairs); NULL for fewer than two known articles. A list brings at most its own length."""
    e = top.select(F.struct(*keys).alias("k"), F.col("pos").alias("ord"), "article_id").join(vectors.select("article_id", "vec"), "article_id")

    def spread(w: np.ndarray, m: np.ndarray, first: np.ndarray) -> pa.Array:
        n = np.add.reduceat(w, first)
        total = (np.add.reduceat(m, first) ** 2).sum(1) - np.add.reduceat((m * m).sum(1), first)
        return pa.array(1.0 - total / np.where(n > 1, n * (n - 1), 1.0), mask=n < 2)

    out = reduce_lists(e.select("k", "ord", F.lit(1.0).alias("w"), "vec"), "k", "length of a list", "diversity", "double", spread)
    return out.select(*[F.col(f"k.{c}").alias(c) for c in keys], "diversity")


def novelty(top: DataFrame, pop: DataFrame, keys: tuple[str, ...] = ("impression_id",)) -> DataFrame:
    """``keys, novelty``: mean of -log2 p; an unknown article has the least probability."""
    floor = pop.agg(F.min("p").alias("p0"))
    j = top.join(pop, "article_id", "left").join(F.broadcast(floor))
    return j.groupBy(*keys).agg(F.avg(-F.log2(F.coalesce("p", "p0"))).alias("novelty"))


def coverage(top: DataFrame, arts: DataFrame) -> DataFrame:
    n = arts.agg(F.count(F.lit(1)).alias("n"))
    return top.agg(F.countDistinct("article_id").alias("c")).join(F.broadcast(n)).select((F.col("c") / F.col("n")).alias("coverage"))


def recall_at(truth: DataFrame, found: DataFrame, ks: tuple[int, ...], indexed: DataFrame | None = None) -> DataFrame:
    """``impression_id, k, recall``: share of the clicked articles within the first k found. With
    ``indexed`` only clicks on indexed articles count, and impressions without any drop out."""
    t = truth.select("impression_id", "article_id").distinct()
    if indexed is not None:
        t = t.join(indexed.select("article_id"), "article_id", "left_semi")
    j = t.join(found.select("impression_id", "article_id", "rank"), ["impression_id", "article_id"], "left")
    e = j.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return e.groupBy("impression_id", "k").agg((F.sum(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("recall"))


def sliced_means(per: DataFrame, slices: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Means by slice, with the slice 'overall' over all; NULLs don't count."""
    e = per.join(slices, "impression_id", "left").withColumn("slice", F.explode(F.array_compact(F.array(F.lit("overall"), F.col("slice")))))
    return e.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
