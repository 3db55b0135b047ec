"""The whole way from articles and impressions to scores, ranks, predictions and reports.

``build_index`` fits both indices, ``retrieval_scores`` gives the three scores of every candidate in one
plan, ``prediction_lines`` ranks them, ``evaluate`` and ``before_after`` report metrics with intervals by slice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import bm25f, metrics, ranking, resample, semantic, whole
from newsloom.operators.bm25f import Bm25f
from newsloom.operators.history import DECAY, RECENT
from newsloom.shared import materialize
from newsloom.sources import click_log, sinks

SCORES = ("bm25_score", "semantic_score", "fusion_score")
SIX = ("auc", "mrr", "ndcg5", "ndcg10", "diversity", "novelty")


@dataclass
class Index:
    """Postings and vectors of a corpus, with the articles they were made of."""

    articles: DataFrame
    postings: DataFrame
    vectors: DataFrame
    config: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, root: str) -> None:
        sinks.save_index(spark, root, self.config, articles=self.articles, postings=self.postings, vectors=self.vectors)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Index:
        config, tables = sinks.load_index(spark, root)
        return cls(config=config, **tables)


def build_index(
    arts: DataFrame,
    backend: str = "lsa",
    cfg: Bm25f = Bm25f(),
    vectors: DataFrame | None = None,
    encoder: Callable[[list[str]], np.ndarray] | None = None,
    size: int = 128,
    entity_vecs: DataFrame | None = None,
    entity_weight: float = 1.0,
) -> Index:
    """Fit the lexical and the semantic index. ``backend``: 'lsa' fits latent vectors of ``size``
    dimensions, 'encoder' calls a batch encoder of texts, 'vectors' takes ``vectors`` (article_id,
    vec) as they are. With ``entity_vecs`` (entity_id, vec) content and entities are fused."""
    if backend == "lsa":
        content = semantic.Lsa(size).fit(arts)
    elif backend == "encoder" and encoder is not None:
        content = semantic.encode(arts, encoder, size)
    elif backend == "vectors" and vectors is not None:
        content = vectors
    else:
        raise ValueError(f"backend {backend!r} without what it needs")
    if entity_vecs is not None:
        width = entity_vecs.select(F.max(F.size("vec"))).first()[0] or 0
        content = semantic.fused_vectors(content, semantic.entity_means(arts, entity_vecs, width), entity_weight)
    config = {"backend": backend, "size": size, "entity_fusion": entity_vecs is not None, "entity_weight": entity_weight, "bm25f": asdict(cfg), "recent": RECENT, "decay": DECAY}
    return Index(arts, materialize(bm25f.postings(arts, cfg), "postings"), materialize(content, "vectors"), config)


def retrieval_scores(inter: DataFrame, index: Index, alpha: float = 0.7, boost: float = 1.0, most: int = whole.NUMBERS) -> DataFrame:
    """``impression_id, pos, article_id, label, bm25_score, semantic_score, fusion_score`` of every candidate of
    the impressions: lexical with entities, cosine with the pooled history, and both scaled and weighed. An index
    of at most ``most`` numbers is read whole by every task, and impressions stay where they are; beyond that
    their terms and vectors are joined."""
    if whole.numbers(index.postings, index.vectors) <= most:
        out = whole.score_lists(inter, whole.ship(index.postings, index.articles, index.vectors, boost), alpha)
        return out.select("impression_id", "pos", "article_id", "label", *[F.round(c, 9).alias(c) for c in SCORES])
    cands = click_log.candidates(inter)
    terms = materialize(bm25f.query_terms(inter, index.articles, vocab=index.postings.select("term").distinct()), "terms")
    lex = bm25f.score_candidates(cands, terms, index.postings, index.articles, bm25f.query_entities(inter, index.articles), boost)
    sem = semantic.score_candidates(cands, semantic.user_vectors(inter, index.vectors), index.vectors)
    both = lex.join(sem.drop("article_id"), ["impression_id", "pos"]).join(cands.select("impression_id", "pos", "label"), ["impression_id", "pos"])
    both = both.select("impression_id", "pos", "article_id", "label", F.round("bm25_score", 9).alias("bm25_score"), F.round("semantic_score", 9).alias("semantic_score"))
    fused = ranking.fuse_scores(both, "bm25_score", "semantic_score", alpha)
    return fused.withColumn("fusion_score", F.round("fusion_score", 9))


def stacked(scored: DataFrame, methods: tuple[str, ...], *keep: str) -> DataFrame:
    """One row per candidate and method: ``method, impression_id, pos, article_id, score`` and ``keep``."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in methods]))
    cols = ("impression_id", "pos", "article_id", *keep)
    return scored.select(*cols, each.alias("x")).select("x.method", *cols, "x.score")


def prediction_lines(scored: DataFrame, methods: tuple[str, ...] = SCORES) -> DataFrame:
    """``method, impression_id, line``: the ranks of an impression's list in display order."""
    ranked = ranking.ordinal_ranks(stacked(scored, methods), "score", by=("method", "impression_id"))
    return ranking.rank_lines(ranked, by=("method", "impression_id"))


def impression_figures(scored: DataFrame, methods: tuple[str, ...], vectors: DataFrame, pop: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The six metrics per method and impression, and the lists of the best k they come from."""
    keys = ("method", "impression_id")
    rows = stacked(scored, methods, "label")
    top = materialize(ranking.ordinal_ranks(rows, "score", by=keys).where(F.col("rank") <= k), "best-k")
    per = metrics.impression_metrics(rows, "score", keys)
    for extra in (metrics.diversity(top, vectors, keys), metrics.novelty(top, pop, keys)):
        per = per.join(extra, list(keys), "left")
    return materialize(per, "figures"), top


def _by_slice(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """Each row once for 'overall' and once for each slice (impression_id, slice) of its impression."""
    s = slices.where("slice IS NOT NULL").groupBy("impression_id").agg(F.collect_set("slice").alias("__s"))  # a few a row
    names = F.explode(F.concat(F.array(F.lit("overall")), F.coalesce("__s", F.array().cast("array<string>"))))
    return rows.join(s, "impression_id", "left").withColumn("slice", names).drop("__s")


def evaluate(per: DataFrame, top: DataFrame, slices: DataFrame, n_docs: DataFrame, n_boot: int = 1000, values: tuple[str, ...] = SIX) -> DataFrame:
    """``method, slice, metric, mean, lo, hi, n``: means of the metrics with intervals, and coverage of the
    catalogue (``n_docs``: one row, n), by method and slice."""
    keys = ("method", "slice")
    means = resample.intervals(_by_slice(per, slices), values, keys, n_boot=n_boot)
    return means.unionByName(resample.coverage_intervals(_by_slice(top, slices), n_docs, keys, n_boot=n_boot))


def before_after(per: DataFrame, slices: DataFrame, before: str, after: str, n_boot: int = 1000, values: tuple[str, ...] = SIX) -> DataFrame:
    """``slice, metric, before, after, delta, lo, hi, n, excludes_zero``: paired differences of two methods
    over impressions with both figures; the means are over all figures of each."""
    a, b = (per.where(F.col("method") == m).select("impression_id", *[F.col(v).alias(f"{n}_{v}") for v in values]) for n, m in (("a", before), ("b", after)))
    pairs = _by_slice(a.join(b, "impression_id"), slices)
    delta = resample.intervals(pairs.select("impression_id", "slice", *[(F.col(f"b_{v}") - F.col(f"a_{v}")).alias(v) for v in values]), values, ("slice",), n_boot=n_boot)
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"a_{v}").alias("before"), F.col(f"b_{v}").alias("after")) for v in values]))
    means = pairs.groupBy("slice").agg(*[F.avg(f"{n}_{v}").alias(f"{n}_{v}") for n in "ab" for v in values]).select("slice", both.alias("x")).select("slice", "x.*")
    out = means.join(delta, ["slice", "metric"])
    return out.select("slice", "metric", "before", "after", F.col("mean").alias("delta"), "lo", "hi", "n", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


def better_method(report: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Adds ``better``: whether a method has the highest value among those of the same ``by``; of equal ones
    the first by name."""
    top = report.groupBy(*by).agg(F.min_by("method", F.struct(-F.col(value), F.col("method"))).alias("__best"))
    return report.join(top, list(by)).withColumn("better", F.col("method") == F.col("__best")).drop("__best")
