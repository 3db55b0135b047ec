"""Queries of the data-processing operators (problems 2, 4, 5 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.asof import known_attributes, known_versions
from newsloom.operators.hot_keys import key_quantiles
from newsloom.operators.packed import one_per_record, unpack, unpack_values
from newsloom.operators.sessions import sessions_from_log
from newsloom.session import table

ENTITIES = {"user": "user_id", "session": "session_id", "article": "article_id"}
VALUES = {"user": "user_avg_past_read_time", "session": "session_prior_click_count", "article": "article_train_ctr"}


def _profiles(spark: SparkSession, d: str, min_share: float | None) -> DataFrame:
    users = key_quantiles(table(spark, d, "behaviors"), "user_id", "read_time", min_share=min_share)
    shown = table(spark, d, "candidate_features").where("split = 'train'")
    arts = key_quantiles(shown, "candidate_article_id", "reranker_score", min_share=min_share)
    return users.withColumn("key_kind", F.lit("user")).unionByName(arts.withColumn("key_kind", F.lit("article")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d, 0.01).select("key_kind", "key_value")


def p2_key_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = [F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return _profiles(spark, d, None).select("key_kind", "key_value", "n_rows", "n_values", *q)


def _packed(spark: SparkSession, d: str, read) -> DataFrame:
    b = one_per_record(table(spark, d, "behaviors"), "impression_id", ["impressions", "history"], "ingested_time")
    a = one_per_record(table(spark, d, "articles"), "article_id", ["subcategory"])
    return read(b, "impression_id", "impressions", "ids").unionByName(read(b, "impression_id", "history", "ids")).unionByName(read(a, "article_id", "subcategory", "names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, unpack_values).select("field", "record_id", "pos", "val")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """All values with the errors of text and value."""
    return _packed(spark, d, unpack)


def p4_ids(spark: SparkSession, d: str) -> DataFrame:
    """The two lists of ids, which SQL can read as well."""
    b = one_per_record(table(spark, d, "behaviors"), "impression_id", ["impressions", "history"], "ingested_time")
    return unpack_values(b, "impression_id", "impressions", "ids").unionByName(unpack_values(b, "impression_id", "history", "ids"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return known_versions(table(spark, d, "behaviors"), table(spark, d, "feature_versions"), "impression_id", "impression_time", ENTITIES)


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    k = known_attributes(table(spark, d, "behaviors"), table(spark, d, "feature_versions"), "impression_id", "impression_time", ENTITIES, VALUES)
    return k.select("impression_id", *[F.round(c, 6).alias(c) for c in VALUES.values()])


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "behaviors").select("user_id", "impression_id", "impression_time", "ingested_time")
    return sessions_from_log(b, "user_id", "impression_id", "impression_time", "ingested_time")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_id", "first_impression_id", "last_impression_id")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_id", "session_start", "session_end", F.round("duration_s", 6).alias("duration_s"), "n_impressions", "first_impression_id", "last_impression_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_key_quantiles, p4_found, p4_values, p4_ids, p5_found, p5_attributes, p6_found, p6_sessions)}

_ONE_EVENT = "SELECT impression_id, min(impression_time) impression_time, min(user_id) user_id, min(session_id) session_id, min(article_id) article_id FROM behaviors WHERE impression_id IS NOT NULL AND impression_time IS NOT NULL GROUP BY 1"
_KNOWN = f"""
WITH e AS ({_ONE_EVENT}),
l AS (
  SELECT impression_id, impression_time t, 'user' kind, CAST(user_id AS VARCHAR) id FROM e
  UNION ALL SELECT impression_id, impression_time, 'session', CAST(session_id AS VARCHAR) FROM e
  UNION ALL SELECT impression_id, impression_time, 'article', article_id FROM e),
r AS (
  SELECT l.impression_id, l.kind entity_kind, v.*, row_number() OVER (PARTITION BY l.impression_id, l.kind ORDER BY v.valid_from DESC, v.recorded_at DESC, v.version_id DESC) rn
  FROM l JOIN (SELECT entity_kind k, entity_id, version_id, valid_from, recorded_at, user_avg_past_read_time, session_prior_click_count, article_train_ctr FROM feature_versions) v
  ON l.kind = v.k AND l.id = v.entity_id AND v.valid_from < l.t AND v.recorded_at < l.t)
"""
_SESSIONS = """
WITH e AS (SELECT impression_id, min(impression_time) t, min(user_id) user_id FROM behaviors WHERE user_id IS NOT NULL AND impression_time IS NOT NULL AND impression_id IS NOT NULL GROUP BY 1),
g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(t) OVER w, t) <= 1800000000 THEN 0 ELSE 1 END n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, impression_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, impression_id ROWS UNBOUNDED PRECEDING) sid FROM g)
"""
SQL = {
    "p2_found": """
SELECT 'user' key_kind, CAST(user_id AS VARCHAR) key_value FROM behaviors WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM behaviors)
UNION ALL
SELECT 'article', candidate_article_id FROM candidate_features WHERE split = 'train' AND candidate_article_id IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM candidate_features WHERE split = 'train')""",
    "p2_key_quantiles": """
WITH l AS (
  SELECT 'user' key_kind, CAST(user_id AS VARCHAR) key_value, CASE WHEN isnan(read_time) THEN NULL ELSE CAST(read_time AS DOUBLE) END v FROM behaviors WHERE user_id IS NOT NULL
  UNION ALL SELECT 'article', candidate_article_id, CASE WHEN isnan(reranker_score) THEN NULL ELSE reranker_score END FROM candidate_features WHERE split = 'train' AND candidate_article_id IS NOT NULL)
SELECT key_kind, key_value, count(*) n_rows, count(v) n_values,
  round(quantile_disc(v, 0.25), 6) q25, round(quantile_disc(v, 0.5), 6) q50, round(quantile_disc(v, 0.75), 6) q75
FROM l GROUP BY 1, 2""",
    "p4_ids": " UNION ALL ".join(
        f"""SELECT '{f}' field, CAST(impression_id AS VARCHAR) record_id, CAST(generate_subscripts(v, 1) AS INTEGER) pos, unnest(v) val
FROM (SELECT impression_id, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_\\-]+') v FROM (SELECT impression_id, arg_min({f}, (ingested_time, {f})) t FROM (SELECT * REPLACE (coalesce(ingested_time, '1500-01-01'::TIMESTAMP) AS ingested_time) FROM behaviors) WHERE impression_id IS NOT NULL AND {f} IS NOT NULL GROUP BY 1))"""
        for f in ("impressions", "history")
    ),
    "p5_found": _KNOWN + "SELECT impression_id, entity_kind, version_id FROM r WHERE rn = 1",
    "p5_attributes": _KNOWN
    + """SELECT impression_id, round(max(CASE WHEN entity_kind = 'user' THEN user_avg_past_read_time END), 6) user_avg_past_read_time,
  round(max(CASE WHEN entity_kind = 'session' THEN CAST(session_prior_click_count AS DOUBLE) END), 6) session_prior_click_count,
  round(max(CASE WHEN entity_kind = 'article' THEN article_train_ctr END), 6) article_train_ctr FROM r WHERE rn = 1 GROUP BY 1""",
    "p6_found": _SESSIONS + "SELECT user_id, arg_min(impression_id, (t, impression_id)) first_impression_id, arg_max(impression_id, (t, impression_id)) last_impression_id FROM s GROUP BY user_id, sid",
    "p6_sessions": _SESSIONS
    + """SELECT user_id, epoch_us(min(t)) session_start, epoch_us(max(t)) session_end, round((epoch_us(max(t)) - epoch_us(min(t))) / 1e6, 6) duration_s, count(*) n_impressions,
  arg_min(impression_id, (t, impression_id)) first_impression_id, arg_max(impression_id, (t, impression_id)) last_impression_id FROM s GROUP BY user_id, sid""",
}
