"""Base tables of the queries, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import table
from newsloom.shared import materialize
from newsloom.sources import click_log


def arts(s: SparkSession, d: str) -> DataFrame:
    return click_log.articles(table(s, d, "articles"))


def inter(s: SparkSession, d: str) -> DataFrame:
    return click_log.interactions(table(s, d, "behaviors"))


def stored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, interactions and candidates for queries that use them several times: parsed once."""
    i = materialize(inter(s, d), "interactions")
    return materialize(arts(s, d), "articles"), i, click_log.candidates(i)


def cands(s: SparkSession, d: str) -> DataFrame:
    return click_log.candidates(inter(s, d))


def article_number():
    return F.regexp_extract("article_id", "([0-9]+)$", 1).try_cast("long")


def vectors(s: SparkSession, d: str) -> DataFrame:
    """A vector for every article: its number modulo the number of vectors names the row of the
    embeddings table (ids there are 0, 1, ...)."""
    e = table(s, d, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    a = arts(s, d).select("article_id").join(F.broadcast(n)).select("article_id", F.pmod(article_number(), F.col("n")).alias("vec_id"))
    return a.join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), "vec_id").select("article_id", "vec")


def r6(c):
    return F.round(c, 6).alias(c) if isinstance(c, str) else F.round(c, 6)


ID = r"[\p{L}\p{M}\p{N}_\-]+"
ART = """art AS MATERIALIZED (SELECT * REPLACE (coalesce(entities, CAST([] AS VARCHAR[])) AS entities) FROM articles WHERE article_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY (url IS NULL), last_modified_time DESC NULLS LAST, title NULLS LAST) = 1)"""
IMP = f"""imp AS MATERIALIZED (SELECT impression_id, user_id, session_id, impression_time, read_time, scroll_percentage, split,
    regexp_extract_all(coalesce(history, ''), '{ID}') hist,
    [x for x in regexp_extract_all(coalesce(impressions, ''), '{ID}') if NOT contains(x, '-') OR TRY_CAST(regexp_extract(x, '^(.*)-([^-]*)$', 2) AS INTEGER) IS NOT NULL] toks
  FROM behaviors WHERE impression_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY ingested_time NULLS LAST, impressions NULLS LAST) = 1)"""
CND = """cnd AS MATERIALIZED (SELECT impression_id, user_id, impression_time, split, pos, CASE WHEN contains(tok, '-') THEN regexp_extract(tok, '^(.*)-([^-]*)$', 1) ELSE tok END article_id,
    CASE WHEN contains(tok, '-') THEN TRY_CAST(regexp_extract(tok, '^(.*)-([^-]*)$', 2) AS INTEGER) END AS label
  FROM (SELECT *, unnest(toks) tok, generate_subscripts(toks, 1) pos FROM imp))"""
HIST = """hst AS MATERIALIZED (SELECT impression_id, split, article_id, hpos, pow(0.85, m - hpos) weight FROM
    (SELECT impression_id, split, unnest(r) article_id, generate_subscripts(r, 1) hpos, len(r) m FROM (SELECT impression_id, split, list_slice(hist, greatest(len(hist) - 19, 1), len(hist)) r FROM imp)))"""
VEC = """vec AS MATERIALIZED (SELECT article_id, CAST(embedding AS DOUBLE[]) vec FROM (SELECT article_id, CAST(regexp_extract(article_id, '([0-9]+)$', 1) AS BIGINT) % n vec_id FROM art, (SELECT count(*) n FROM embeddings)) JOIN embeddings USING (vec_id))"""
#: uv(impression_id, split, dim, x) and ul(impression_id, u): unit vectors of the pooled histories
POOLED = """up AS (SELECT impression_id, split, d, sum(weight * x) / sum(weight) m FROM (SELECT impression_id, split, weight, unnest(vec) x, generate_subscripts(vec, 1) d FROM hst JOIN vec USING (article_id)) GROUP BY 1, 2, 3),
uv AS MATERIALIZED (SELECT impression_id, split, d - 1 dim, m / sqrt(sum(m * m) OVER (PARTITION BY impression_id)) x FROM up),
ul AS MATERIALIZED (SELECT impression_id, list(x ORDER BY dim) u FROM uv GROUP BY 1)"""
TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
