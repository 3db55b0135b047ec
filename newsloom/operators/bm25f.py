"""BM25F as an inverted index: postings are a table, scoring is a join and a sum.

A term's frequency in a document is the sum over fields of weight * count / (1 - b + b * length /
mean length of the field); its weight is idf * f * (k1 + 1) / (f + k1). Vocabulary: terms in at
least ``min_df`` documents and at most ``max_df`` of all. Lengths count vocabulary terms only.

Joins with exploded terms name their method: Spark estimates such rows by the size of the files they were
exploded from, so it would broadcast what doesn't fit the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import tokens
from newsloom.operators.history import DECAY, RECENT, recent_weights
from newsloom.shared import materialize, ship_package, spread


@dataclass(frozen=True)
class Bm25f:
    k1: float = 1.5
    b: float = 0.75
    min_df: int = 2
    max_df: float = 0.6
    weights: dict[str, float] = field(default_factory=lambda: {"title": 2.0, "abstract": 1.0})
    entity_boost: float = 1.0


def field_tokens(arts: DataFrame, cfg: Bm25f = Bm25f()) -> DataFrame:
    """``article_id, field, term, n``: counts of each term in each field."""
    fs = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("toks")) for f in cfg.weights])
    e = arts.select("article_id", F.explode(fs).alias("x")).select("article_id", "x.field", F.explode("x.toks").alias("term"))
    return e.groupBy("article_id", "field", "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(arts: DataFrame, counts: DataFrame, cfg: Bm25f = Bm25f()) -> DataFrame:
    """``term, df`` of the terms kept."""
    n = arts.agg(F.count(F.lit(1)).alias("n_docs"))
    df = counts.groupBy("term").agg(F.countDistinct("article_id").alias("df"))
    return df.join(F.broadcast(n)).where((F.col("df") >= cfg.min_df) & (F.col("df") <= F.lit(cfg.max_df) * F.col("n_docs"))).select("term", "df", "n_docs")


def field_stats(arts: DataFrame, cfg: Bm25f = Bm25f(), counts: DataFrame | None = None) -> DataFrame:
    """``article_id, field, term, n, len, mean_len, df, n_docs`` of vocabulary terms."""
    counts = field_tokens(arts, cfg) if counts is None else counts
    kept = counts.join(vocabulary(arts, counts, cfg).hint("merge"), "term")
    per_doc = kept.groupBy("article_id", "field").agg(F.sum("n").alias("len"))
    n = arts.agg(F.count(F.lit(1)).alias("m"))
    mean = per_doc.groupBy("field").agg(F.sum("len").alias("tot")).join(F.broadcast(n)).select("field", (F.col("tot") / F.col("m")).alias("mean_len"))  # one row per field
    return kept.join(per_doc.hint("merge"), ["article_id", "field"]).join(F.broadcast(mean), "field")


def weigh(stats: DataFrame, cfg: Bm25f = Bm25f()) -> DataFrame:
    """Postings from field statistics."""
    k1, b = F.lit(cfg.k1), F.lit(cfg.b)
    w = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(x))) for f, x in cfg.weights.items()], F.lit(1.0))
    part = w * F.col("n") / (1.0 - b + b * F.col("len") / F.col("mean_len"))
    g = stats.withColumn("part", part).groupBy("article_id", "term").agg(F.sum("part").alias("f"), F.max("df").alias("df"), F.max("n_docs").alias("n_docs"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), F.lit(1e-6))
    return g.withColumn("idf", idf).withColumn("weight", F.col("idf") * F.col("f") * (k1 + 1.0) / (F.col("f") + k1)).select("article_id", "term", "weight")


def postings(arts: DataFrame, cfg: Bm25f = Bm25f()) -> DataFrame:
    """``article_id, term, weight``."""
    return weigh(field_stats(arts, cfg), cfg)


def article_terms(arts: DataFrame) -> DataFrame:
    """Distinct tokens of title and abstract."""
    both = F.array_distinct(F.concat(tokens(F.col("title")), tokens(F.col("abstract"))))
    return arts.select("article_id", F.explode(both).alias("term"))


def query_terms(inter: DataFrame, arts: DataFrame, n: int = RECENT, decay: float = DECAY, vocab: DataFrame | None = None) -> DataFrame:
    """``impression_id, term, qw``: weights of the recent history summed over each article's distinct
    terms. ``vocab`` keeps only its terms (others can't score)."""
    t = article_terms(arts)
    if vocab is not None:
        t = t.join(vocab.select("term"), "term", "left_semi")
    h = recent_weights(inter, n, decay).groupBy("impression_id", "article_id").agg(F.sum("weight").alias("weight"))
    return h.join(t.hint("merge"), "article_id").groupBy("impression_id", "term").agg(F.sum("weight").alias("qw"))


def query_entities(inter: DataFrame, arts: DataFrame, n: int = RECENT, decay: float = DECAY) -> DataFrame:
    """``impression_id, entity, qw``, likewise over distinct entities."""
    e = arts.select("article_id", F.explode(F.array_distinct("entities")).alias("entity"))
    h = recent_weights(inter, n, decay).groupBy("impression_id", "article_id").agg(F.sum("weight").alias("weight"))
    return h.join(e.hint("merge"), "article_id").groupBy("impression_id", "entity").agg(F.sum("weight").alias("qw"))


def score_candidates(cands: DataFrame, terms: DataFrame, index: DataFrame, arts: DataFrame | None = None, entities: DataFrame | None = None, boost: float = 1.0) -> DataFrame:
    """``impression_id, pos, article_id, bm25_score`` of shown articles only. Unknown articles and terms
    score 0. With entities their shared weights are added, times ``boost``."""
    shown = cands.select("impression_id", "article_id").distinct()
    hit = shown.join(index.hint("merge"), "article_id").join(spread(terms, "impression_id", "term").hint("merge"), ["impression_id", "term"])
    s = hit.groupBy("impression_id", "article_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("s"))
    if entities is not None and arts is not None:
        de = arts.select("article_id", F.explode(F.array_distinct("entities")).alias("entity"))
        x = shown.join(de.hint("merge"), "article_id").join(entities.hint("merge"), ["impression_id", "entity"]).groupBy("impression_id", "article_id").agg((F.sum("qw") * F.lit(boost)).alias("x"))
        s = s.join(x, ["impression_id", "article_id"], "full").select("impression_id", "article_id", (F.coalesce("s", F.lit(0.0)) + F.coalesce("x", F.lit(0.0))).alias("s"))
    return cands.join(s, ["impression_id", "article_id"], "left").select("impression_id", "pos", "article_id", F.coalesce("s", F.lit(0.0)).alias("bm25_score"))


def score_all(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``impression_id, article_id, score`` of every article that shares a term with the query."""
    return spread(terms, "impression_id").join(index.hint("merge"), "term").groupBy("impression_id", "article_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def search_top(terms: DataFrame, index: DataFrame, k: int, queries: int = 1024, articles: int = 8192) -> DataFrame:
    """``impression_id, rank, article_id, score``: the k best of the whole corpus, equal scores (to 9
    places) by article; articles sharing no term never come out.

    Queries and articles are cut into blocks by hash; a pair of blocks is one sparse product that
    keeps k per query, so of the sums of a pair only those leave its task. Terms are numbered first.
    ``terms`` and ``index`` should be stored tables, for they are read several times.
    """
    ship_package(terms.sparkSession)
    ids = materialize(index.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "term-ids")
    blocks = lambda d, c, size: max(1, -(-d.agg(F.approx_count_distinct(c)).first()[0] // size))
    nq, na = blocks(terms, "impression_id", queries), blocks(index, "article_id", articles)
    place = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = terms.join(ids, "term").select("impression_id", F.col("tid").alias("tid"), "qw", place("impression_id", nq).alias("__q"), every(na).alias("__a"))
    right = index.join(ids, "term").select("article_id", F.col("tid").alias("id"), "weight", place("article_id", na).alias("__a"), every(nq).alias("__q"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"impression_id": x["impression_id"][:0], "article_id": y["article_id"][:0], "score": np.zeros(0)})]
        if len(x) and len(y):
            arts, a = np.unique(y["article_id"].to_numpy(dtype=str), return_inverse=True)
            order = np.argsort(y["id"].to_numpy(), kind="stable")
            tid, a, weight = y["id"].to_numpy()[order], a[order], y["weight"].to_numpy()[order]
            x = x.sort_values("impression_id", kind="stable")
            lo, hi = (np.searchsorted(tid, x["tid"].to_numpy(), side=s) for s in ("left", "right"))
            qids, q = np.unique(x["impression_id"].to_numpy(), return_inverse=True)
            for part in _parts(q, hi - lo, len(arts)):
                n = (hi - lo)[part]
                at = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                first, last = q[part.start], q[part.stop - 1]
                flat = np.repeat(q[part] - first, n) * len(arts) + a[at]
                size = (last - first + 1) * len(arts)
                s = np.bincount(flat, np.repeat(x["qw"].to_numpy()[part], n) * weight[at], size).reshape(-1, len(arts))
                hit = np.bincount(flat, minlength=size).reshape(s.shape) > 0
                r = np.where(hit, np.round(s, 9), -np.inf)
                top = np.argsort(-r, axis=1, kind="stable")[:, :k]
                ok = np.take_along_axis(hit, top, 1)
                found.append(pd.DataFrame({"impression_id": np.repeat(qids[first : last + 1], ok.sum(1)), "article_id": arts[top[ok]], "score": np.take_along_axis(s, top, 1)[ok]}))
        return pd.concat(found)

    kind = terms.schema["impression_id"].dataType.simpleString()
    out = left.groupBy("__q", "__a").cogroup(right.groupBy("__q", "__a")).applyInPandas(best, f"impression_id {kind}, article_id string, score double")
    w = W.partitionBy("impression_id").orderBy(F.round("score", 9).desc(), "article_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("impression_id", "rank", "article_id", "score")


def _parts(q: np.ndarray, n: np.ndarray, width: int, most: int = 4_000_000) -> Iterator[slice]:
    """Slices of whole queries whose matches and dense rows stay below ``most`` numbers."""
    ends = np.flatnonzero(np.diff(q, append=-1)) + 1
    start = at = 0
    total = np.concatenate([[0], np.cumsum(n)])
    rows = 0
    for e in ends:
        rows += 1
        if at > start and (total[e] - total[start] > most or rows * width > most):
            yield slice(start, at)
            start, rows = at, 1
        at = int(e)
    yield slice(start, at)


def grid_scores(cands: DataFrame, terms: DataFrame, stats: DataFrame, k1s: Sequence[float], bs: Sequence[float], cfg: Bm25f = Bm25f()) -> DataFrame:
    """``impression_id, article_id, s`` with one score per (k1, b), in the order of k1s then bs: the
    frequencies of every b stand side by side, so the terms are joined once for the whole grid."""
    w = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(x))) for f, x in cfg.weights.items()], F.lit(1.0))
    part = lambda b: F.sum(w * F.col("n") / (1.0 - F.lit(b) + F.lit(b) * F.col("len") / F.col("mean_len")))
    idf = F.greatest(F.log((F.max("n_docs") - F.max("df") + 0.5) / (F.max("df") + 0.5) + 1.0), F.lit(1e-6))
    index = stats.groupBy("article_id", "term").agg(idf.alias("idf"), *[part(b).alias(f"f{j}") for j, b in enumerate(bs)])
    hit = cands.select("impression_id", "article_id").distinct().join(index, "article_id").join(spread(terms, "impression_id", "term"), ["impression_id", "term"])
    point = lambda k1, j: F.sum(F.col("qw") * F.col("idf") * F.col(f"f{j}") * F.lit(k1 + 1.0) / (F.col(f"f{j}") + F.lit(k1)))
    sums = [point(k1, j).alias(f"s{i}_{j}") for i, k1 in enumerate(k1s) for j in range(len(bs))]
    return hit.groupBy("impression_id", "article_id").agg(*sums).select("impression_id", "article_id", F.array(*[f"s{i}_{j}" for i in range(len(k1s)) for j in range(len(bs))]).alias("s"))
