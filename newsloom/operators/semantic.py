"""Vector retrieval: pooled user vectors, candidate cosines, exact top k, entity fusion, LSA."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import article_text, tokens
from newsloom.functions.vectors import as_lists, dot, fuse, reduce_lists, sum_vectors, unit
from newsloom.operators.history import DECAY, RECENT, recent_weights
from newsloom.shared import materialize, ship_package
from newsloom.sources import sinks


def _unit_means(w: np.ndarray, m: np.ndarray, first: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(m * w[:, None], first) / np.add.reduceat(w, first)[:, None]
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(length > 1e-12, length, 1.0)


def user_vectors(inter: DataFrame, vectors: DataFrame, n: int = RECENT, decay: float = DECAY) -> DataFrame:
    """``impression_id, user_vec``: unit vector of the weighted mean over the recent history's known
    articles; impressions without any give no row. An impression brings at most n vectors."""
    h = recent_weights(inter, n, decay).join(vectors.select("article_id", "vec"), "article_id").select("impression_id", F.col("hpos").alias("ord"), F.col("weight").alias("w"), "vec")
    return reduce_lists(h, "impression_id", "recent history", "user_vec", "array<double>", lambda w, m, first: as_lists(_unit_means(w, m, first)))


def score_candidates(cands: DataFrame, users: DataFrame, vectors: DataFrame) -> DataFrame:
    """``impression_id, pos, article_id, semantic_score``: dot with the user vector; unknown articles and
    users without vector score 0."""
    j = cands.select("impression_id", "pos", "article_id").join(vectors.select("article_id", "vec"), "article_id", "left").join(users, "impression_id", "left")
    return j.select("impression_id", "pos", "article_id", F.coalesce(dot(F.col("user_vec"), F.col("vec")), F.lit(0.0)).alias("semantic_score"))


def search_top(users: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``impression_id, rank, article_id, score``: exact inner-product top k against the whole corpus.

    Queries and corpus are cut into blocks of about ``block`` vectors by hash; each pair of blocks is
    one matrix product that keeps k per query, and a query's bests of all blocks are merged. Every
    task holds two blocks, the driver none. Equal scores (to 9 places) go by article.
    """
    ship_package(users.sparkSession)
    q, c = users.select("impression_id", "user_vec"), vectors.select("article_id", "vec")
    blocks = lambda d: max(1, -(-d.count() // block))
    nq, nc = blocks(q), blocks(c)
    place = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("__q", place("impression_id", nq)).withColumn("__c", every(nc))
    right = c.withColumn("__c", place("article_id", nc)).withColumn("__q", every(nq))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"impression_id": x["impression_id"][:0], "article_id": [], "score": []})
        y = y.sort_values("article_id")
        s = np.round(np.stack(x["user_vec"].to_numpy()) @ np.stack(y["vec"].to_numpy()).T, 9)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"impression_id": np.repeat(x["impression_id"].to_numpy(), top.shape[1]), "article_id": y["article_id"].to_numpy()[top.ravel()], "score": np.take_along_axis(s, top, 1).ravel()})

    kind = users.schema["impression_id"].dataType.simpleString()
    out = left.groupBy("__q", "__c").cogroup(right.groupBy("__q", "__c")).applyInPandas(best, f"impression_id {kind}, article_id string, score double")
    w = W.partitionBy("impression_id").orderBy(F.col("score").desc(), "article_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("impression_id", "rank", "article_id", "score")


def entity_means(arts: DataFrame, entity_vecs: DataFrame, size: int) -> DataFrame:
    """``article_id, evec``: mean vector of an article's known entities, zeros if none."""
    e = arts.select("article_id", F.explode(F.array_distinct("entities")).alias("entity_id")).join(entity_vecs.select("entity_id", "vec"), "entity_id")
    rows = e.select("article_id", F.col("entity_id").alias("ord"), F.lit(1.0).alias("w"), "vec")
    g = reduce_lists(rows, "article_id", "an article's entities", "m", "array<double>", lambda w, m, first: as_lists(np.add.reduceat(m, first) / np.add.reduceat(w, first)[:, None]))
    return arts.select("article_id").join(g, "article_id", "left").select("article_id", F.coalesce("m", F.array_repeat(F.lit(0.0), size)).alias("evec"))


def fused_vectors(vectors: DataFrame, means: DataFrame, weight: float = 1.0) -> DataFrame:
    return vectors.join(means, "article_id").select("article_id", fuse(F.col("vec"), F.col("evec"), weight).alias("vec"))


def encode(arts: DataFrame, encoder: Callable[[list[str]], np.ndarray], size: int) -> DataFrame:
    """Vectors of article texts by any batch encoder; ``encoder`` must be picklable."""
    ship_package(arts.sparkSession)

    def run(batches):
        for pdf in batches:
            m = np.asarray(encode_(pdf["t"].tolist()), dtype="float64").reshape(len(pdf), size)
            yield pd.DataFrame({"article_id": pdf["article_id"], "vec": list(m)})

    encode_ = encoder
    return arts.select("article_id", article_text(F.col("title"), F.col("abstract")).alias("t")).mapInPandas(run, "article_id string, vec array<double>")


def term_counts(arts: DataFrame) -> DataFrame:
    """``article_id, term, n`` over title and abstract."""
    e = arts.select("article_id", F.explode(tokens(article_text(F.col("title"), F.col("abstract")))).alias("term"))
    return e.groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("n"))


def idf(arts: DataFrame, min_df: int = 2, max_df: float = 0.6) -> DataFrame:
    """``term, df, idf`` of the terms kept: ln((1 + n) / (1 + df)) + 1."""
    total = arts.agg(F.count(F.lit(1)).alias("n_docs"))
    df = term_counts(arts).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    return df.select("term", "df", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh_terms(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``article_id, term, w``: n * idf, unit length per article."""
    x = counts.join(idf.select("term", "idf"), "term").withColumn("x", F.col("n") * F.col("idf"))
    length = x.groupBy("article_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return x.join(length, "article_id").select("article_id", "term", (F.col("x") / F.col("l")).alias("w"))


def tfidf(arts: DataFrame, min_df: int = 2, max_df: float = 0.6) -> DataFrame:
    return weigh_terms(term_counts(arts), idf(arts, min_df, max_df))


class Lsa:
    """Latent semantic vectors. The term basis is found by subspace iteration: each round is two
    joins of the tf-idf table with a (key, k-vector) table; only k x k matrices reach the driver."""

    def __init__(self, size: int = 128, rounds: int = 2, seed: int = 42, min_df: int = 2, max_df: float = 0.6):
        self.size, self.rounds, self.seed, self.min_df, self.max_df = size, rounds, seed, min_df, max_df

    def _times(self, x: DataFrame, basis: DataFrame, on: str, to: str) -> DataFrame:
        """Rows of the product: for every ``to`` the sum of w * basis[on]."""
        rows = x.join(basis, on).select(to, "w", F.col("v").alias("vec"))
        return sum_vectors(rows, to).withColumnRenamed("vec", "v")

    def _orthonormal(self, basis: DataFrame, key: str) -> DataFrame:
        """Columns made orthonormal through the k x k Gram matrix."""
        k = self.size
        def gram(batches):
            g = np.zeros((k, k))
            for pdf in batches:
                if len(pdf):
                    m = np.stack(pdf["v"].to_numpy())
                    g += m.T @ m
            yield pd.DataFrame({"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "x": g.ravel()})

        rows = basis.select("v").mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
        g = np.zeros((k, k))
        g[rows["i"], rows["j"]] = rows["x"]
        vals, vecs = np.linalg.eigh(g)
        keep = vals > max(vals.max(), 1e-300) * 1e-12
        turn = np.where(keep, vecs / np.sqrt(np.where(keep, vals, 1.0)), 0.0)[:, ::-1]

        def apply(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({key: pdf[key], "v": list(np.stack(pdf["v"].to_numpy()) @ turn)})

        return basis.mapInPandas(apply, f"{key} string, v array<double>")

    def fit(self, arts: DataFrame) -> DataFrame:
        """``article_id, vec`` (unit vectors); articles without vocabulary terms give no row."""
        ship_package(arts.sparkSession)
        x = materialize(tfidf(arts, self.min_df, self.max_df), "lsa-tfidf")
        seeds = F.array(*[(F.pmod(F.xxhash64("term", F.lit(self.seed), F.lit(d)), F.lit(2_000_003)) / 1_000_001.5 - 1.0) for d in range(self.size)])
        basis = x.select("term").distinct().select("term", seeds.alias("v"))
        for r in range(self.rounds):
            docs = self._times(x, basis, "term", "article_id")
            basis = materialize(self._orthonormal(materialize(self._times(x, docs, "article_id", "term"), f"lsa-terms{r}"), "term"), f"lsa-basis{r}")
        self.basis = basis
        self.idf = materialize(idf(arts, self.min_df, self.max_df).select("term", "idf"), "lsa-idf")
        out = self._times(x, basis, "term", "article_id")
        return out.select("article_id", unit(F.col("v")).alias("vec"))

    def project(self, arts: DataFrame) -> DataFrame:
        """``article_id, vec`` of articles the fit need not have seen: their terms get the weights of the
        fit, terms it did not keep count for nothing. An article of the fit gets the vector it got there."""
        x = weigh_terms(term_counts(arts), self.idf)
        return self._times(x, self.basis, "term", "article_id").select("article_id", unit(F.col("v")).alias("vec"))

    def save(self, spark: SparkSession, root: str) -> None:
        config = {k: getattr(self, k) for k in ("size", "rounds", "seed", "min_df", "max_df")}
        sinks.save_index(spark, root, config, basis=self.basis, idf=self.idf)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Lsa:
        config, tables = sinks.load_index(spark, root)
        out = cls(**config)
        out.basis, out.idf = tables["basis"], tables["idf"]
        return out
