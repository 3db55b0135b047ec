"""Queries over unified tables: counts, features, histories, profiles, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import features, guards, history, ranking, resample, semantic
from newsloom.plans.base import ART, CND, HIST, IMP, POOLED, VEC, arts, cands, inter, r6, stored, vectors, with_
from newsloom.session import table
from newsloom.sources import click_log


def popularity_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.popularity_ranks(cands(s, d)).select("impression_id", "pos", "article_id", "clicks", "rank")


def rank_lines(s: SparkSession, d: str) -> DataFrame:
    return ranking.rank_lines(ranking.popularity_ranks(cands(s, d)))


def article_features(s: SparkSession, d: str) -> DataFrame:
    return features.article_features(arts(s, d), cands(s, d).where("split = 'train'")).withColumn("train_ctr", r6(F.col("train_ctr")))


def user_features_cutoff(s: SparkSession, d: str) -> DataFrame:
    i = inter(s, d)
    cut = i.where("split = 'val'").agg(F.min("impression_time").alias("cut"))
    clicks = click_log.click_history(i).crossJoin(F.broadcast(cut))  # one row
    f = features.user_features(clicks, F.col("cut"))
    return f.select("user_id", "n_clicks", "n_articles", r6("recency_hours"), r6("tenure_days"))


def click_history(s: SparkSession, d: str) -> DataFrame:
    return click_log.click_history(inter(s, d))


def split_boundaries(s: SparkSession, d: str) -> DataFrame:
    return guards.split_bounds(inter(s, d))


def first_seen_freshness(s: SparkSession, d: str) -> DataFrame:
    c = cands(s, d)
    return features.freshness(c, features.first_seen(c)).select("impression_id", "pos", "article_id", r6("days_since"))


def history_recent_weights(s: SparkSession, d: str) -> DataFrame:
    return history.recent_weights(inter(s, d)).select("impression_id", "article_id", "hpos", r6("weight"))


def category_match(s: SparkSession, d: str) -> DataFrame:
    a, i, c = stored(s, d)
    c = features.category_match(c, i, a)
    return c.select("impression_id", "pos", "article_id", r6("history_category_match"))


def subcategory_match(s: SparkSession, d: str) -> DataFrame:
    a, i, c = stored(s, d)
    return features.category_match(c, i, a, column="subcategory").select("impression_id", "pos", "article_id", r6("history_subcategory_match"))


def _prior(s: SparkSession, d: str, legacy: bool = False) -> DataFrame:
    return prior_of(inter(s, d), legacy)


def prior_of(i: DataFrame, legacy: bool = False) -> DataFrame:
    i = i.withColumn("n_clicked", F.size(F.filter("labels", lambda x: x == 1)))
    return history.prior_figures(i, legacy)


def session_prior_clicks(s: SparkSession, d: str) -> DataFrame:
    return _prior(s, d).select("impression_id", "session_prior_click_count")


def prior_engagement_mean(s: SparkSession, d: str) -> DataFrame:
    return _prior(s, d).select("impression_id", r6("user_avg_past_read_time"), r6("user_avg_past_scroll_pct"))


def prior_engagement_mean_legacy(s: SparkSession, d: str) -> DataFrame:
    return _prior(s, d, True).select("impression_id", r6("user_avg_past_read_time"), r6("user_avg_past_scroll_pct"))


SIX = ("history_category_match", "history_subcategory_match", "train_ctr", "article_days_since_publish", "user_avg_past_read_time", "user_avg_past_scroll_pct")


def built_features(s: SparkSession, d: str) -> DataFrame:
    a, i, c = stored(s, d)
    v = vectors(s, d)
    return features.candidate_features(i, a, c, prior_of(i), semantic.score_candidates(c, semantic.user_vectors(i, v), v))


def candidate_features(s: SparkSession, d: str) -> DataFrame:
    """All features of all candidates, with the likeness of history and article."""
    f = built_features(s, d)
    return f.select(*[F.round(x, 5).alias(x) if x == "history_embedding_sim" else r6(x) if x in SIX else x for x in f.columns])


def feature_score_join(s: SparkSession, d: str) -> DataFrame:
    """Candidates joined with the scores of the same impression and article (latest scored). An article
    shown twice in an impression has one score for both places."""
    c = cands(s, d).select("impression_id", "article_id", "pos", "label")
    return c.join(_last_scores(s, d), ["impression_id", "article_id"]).select("impression_id", "article_id", "pos", "label", *_as_float())


def _last_scores(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "candidate_features").select("impression_id", F.col("candidate_article_id").alias("article_id"), F.nanvl("bm25_score", F.lit(None).cast("double")).alias("b"), F.nanvl("fusion_score", F.lit(None).cast("double")).alias("f"), "scored_at")
    return click_log.first_rows(t, ["impression_id", "article_id"], [F.col("scored_at").desc_nulls_last(), F.col("b").desc_nulls_last(), F.col("f").desc_nulls_last()])


def _as_float() -> list:
    return [F.col("b").cast("float").cast("double").alias("bm25_score"), F.col("f").cast("float").cast("double").alias("fusion_score")]


def assembled_features(s: SparkSession, d: str) -> DataFrame:
    """Rows of the ranker: built features beside scores, each pair of impression and article once, at its
    first place."""
    f = built_features(s, d).select("impression_id", "article_id", "candidate_position", "label", "split", "history_length", "history_category_match", "train_impressions", "article_days_since_publish", "session_prior_click_count")
    one = click_log.first_rows(f, ["impression_id", "article_id"], [F.col("candidate_position")])
    j = one.join(_last_scores(s, d), ["impression_id", "article_id"])
    return j.select("impression_id", "article_id", "candidate_position", "label", "split", "history_length", r6("history_category_match"), "train_impressions", r6("article_days_since_publish"), "session_prior_click_count", *_as_float())


def assembly_losses(s: SparkSession, d: str) -> DataFrame:
    """Rows on either side of that join without a partner, by split of the candidates."""
    c = cands(s, d).select("impression_id", "article_id", "split").distinct()
    t = _last_scores(s, d).where("impression_id IS NOT NULL AND article_id IS NOT NULL").select("impression_id", "article_id", F.lit(True).alias("scored"))
    j = c.withColumn("shown", F.lit(True)).join(t, ["impression_id", "article_id"], "full")
    return j.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count_if(F.col("shown") & F.col("scored").isNull()).alias("not_scored"), F.count_if(F.col("shown").isNull()).alias("not_shown"), F.count_if(F.col("shown") & F.col("scored")).alias("joined"))


def profile_summary(s: SparkSession, d: str) -> DataFrame:
    i = inter(s, d)
    n = F.size("history_ids")
    return i.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("user_id").isNull()).alias("null_users"), F.min("impression_time").alias("first_time"), F.max("impression_time").alias("last_time"),
        r6(F.avg(n)).alias("mean_history"), F.min(n).alias("min_history"), F.max(n).alias("max_history"), F.percentile(n, 0.5).alias("median_history"), r6(F.avg(F.size("candidate_ids"))).alias("mean_shown"),
    )


_NULLABLE = ("user_id", "impression_time", "history", "impressions", "article_id", "session_id", "read_time", "scroll_percentage")


def null_profile(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "behaviors")
    one = b.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in _NULLABLE])
    lines = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in _NULLABLE]))
    return one.select("n", lines.alias("x")).select("x.column_name", "x.n_null", r6(100.0 * F.col("x.n_null") / F.col("n")).alias("pct_null"))


def value_counts(s: SparkSession, d: str) -> DataFrame:
    return arts(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "events").where("value IS NOT NULL")
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return v.groupBy("event_type").agg(p.alias("p"), F.avg("value").alias("mean"), F.max("value").alias("top")).select("event_type", r6(F.col("p")[0]).alias("p50"), r6(F.col("p")[1]).alias("p95"), r6(F.col("p")[2]).alias("p99"), r6("mean"), r6("top"))


def set_union_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Articles of the catalogue, then those only seen in lists; the first source counts."""
    a = arts(s, d).select("article_id", F.lit("catalogue").alias("source"))
    b = cands(s, d).select("article_id").distinct().select("article_id", F.lit("shown").alias("source"))
    return click_log.union_articles(a, b)


def intersect_except(s: SparkSession, d: str) -> DataFrame:
    c = cands(s, d)
    tr, te = (c.where(F.col("split") == x).select("article_id") for x in ("train", "test"))
    return tr.intersect(te).withColumn("part", F.lit("both")).unionByName(te.exceptAll(te.join(tr, "article_id", "left_semi")).distinct().withColumn("part", F.lit("test only")))


def negative_sampling(s: SparkSession, d: str) -> DataFrame:
    return resample.negatives(cands(s, d))


def sampled_impressions(s: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 200 impressions (a sampling operator)."""
    return resample.sample_rows(inter(s, d).select("impression_id", "split"), 200)


def user_sessions_streamable(s: SparkSession, d: str) -> DataFrame:
    """Sessions of the event table by a window of inactivity of 30 minutes."""
    e = table(s, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("user_id", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


QUERIES = {
    f.__name__: f
    for f in (
        popularity_rank, rank_lines, article_features, user_features_cutoff, click_history, split_boundaries, first_seen_freshness, history_recent_weights, category_match,
        session_prior_clicks, prior_engagement_mean, prior_engagement_mean_legacy, candidate_features, feature_score_join, assembled_features, assembly_losses, subcategory_match, profile_summary, null_profile, value_counts,
        latency_percentiles, set_union_dedupe, intersect_except, negative_sampling, sampled_impressions, user_sessions_streamable,
    )
}

_POP = """pop AS (SELECT c.impression_id, c.pos, c.article_id, coalesce(k.clicks, 0) clicks, row_number() OVER (PARTITION BY c.impression_id ORDER BY coalesce(k.clicks, 0) DESC, c.pos) AS rank
  FROM cnd c LEFT JOIN (SELECT article_id, count(*) clicks FROM cnd WHERE split = 'train' AND label = 1 GROUP BY 1) k USING (article_id) WHERE c.split = 'val')"""
_AF = """af AS (SELECT a.article_id, len([x for x in regexp_split_to_array(coalesce(title, ''), '\\s+') if x <> '']) n_title_words, len([x for x in regexp_split_to_array(coalesce(abstract, ''), '\\s+') if x <> '']) n_abstract_words,
    len(entities) n_entities, coalesce(n, 0) train_impressions, coalesce(k, 0) train_clicks, k / n train_ctr
  FROM art a LEFT JOIN (SELECT article_id, count(*) n, count(*) FILTER (label = 1) k FROM cnd WHERE split = 'train' GROUP BY 1) USING (article_id))"""
_SEEN = "seen AS (SELECT article_id, min(impression_time) fs FROM cnd WHERE impression_time IS NOT NULL GROUP BY 1)"
_FRESH = """fr AS (SELECT *, CASE WHEN d >= 0 THEN d END dd FROM (SELECT c.*, date_diff('microsecond', {since}, c.impression_time) / 86400000000.0 d FROM cnd c LEFT JOIN seen USING (article_id) {join}))"""
_DAYS = "coalesce(dd, max(dd) OVER (PARTITION BY split), 0.0)"
_CAT = """cw AS (SELECT impression_id, category, sum(weight) w FROM hst JOIN art USING (article_id) WHERE category IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT impression_id, category, w / sum(w) OVER (PARTITION BY impression_id) share FROM cw)"""
_SUB = """sw AS (SELECT impression_id, subcategory, sum(weight) w FROM hst JOIN art USING (article_id) WHERE subcategory IS NOT NULL GROUP BY 1, 2),
ss AS (SELECT impression_id, subcategory, w / sum(w) OVER (PARTITION BY impression_id) sub_share FROM sw)"""
_PRIOR = """nc AS (SELECT *, CAST(len([x for x in toks if regexp_matches(x, '-1$')]) AS BIGINT) n_clicked, CASE WHEN isnan(read_time) THEN NULL ELSE CAST(read_time AS DOUBLE) END rt, CASE WHEN isnan(scroll_percentage) THEN NULL ELSE CAST(scroll_percentage AS DOUBLE) END sp FROM imp),
pr AS (SELECT impression_id,
    CASE WHEN session_id IS NULL THEN 0 ELSE coalesce(sum(n_clicked) OVER (PARTITION BY session_id ORDER BY impression_time NULLS FIRST, impression_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END pc,
    CASE WHEN user_id IS NOT NULL THEN avg(rt) OVER u END rt, CASE WHEN user_id IS NOT NULL THEN avg(sp) OVER u END sp,
    lag(read_time) OVER u0 lrt, lag(scroll_percentage) OVER u0 lsp FROM nc
  WINDOW u AS (PARTITION BY user_id ORDER BY impression_time NULLS FIRST, impression_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u0 AS (PARTITION BY user_id ORDER BY impression_time NULLS FIRST, impression_id))"""


_BUILT_FROM = (
    ART, IMP, CND, HIST, VEC, POOLED, _CAT, _SUB, _AF, _SEEN, _FRESH.format(since="coalesce(p.published_time, fs)", join="LEFT JOIN (SELECT article_id, published_time FROM art) p USING (article_id)"), _PRIOR,
    f"""built AS (SELECT f.impression_id, f.article_id, f.label, f.split, f.pos candidate_position, len(i.hist) history_length, coalesce(share, 0.0) history_category_match, coalesce(sub_share, 0.0) history_subcategory_match, coalesce(list_dot_product(u, vec), 0.0) history_embedding_sim,
  coalesce(af.train_ctr, 0.0) train_ctr, coalesce(af.train_impressions, 0) train_impressions, {_DAYS.replace("split", "f.split")} article_days_since_publish, CAST(coalesce(pc, 0) AS BIGINT) session_prior_click_count, coalesce(rt, 0.0) user_avg_past_read_time, coalesce(sp, 0.0) user_avg_past_scroll_pct
FROM fr f JOIN imp i USING (impression_id) LEFT JOIN art a ON a.article_id = f.article_id LEFT JOIN sh ON sh.impression_id = f.impression_id AND sh.category = a.category LEFT JOIN ss ON ss.impression_id = f.impression_id AND ss.subcategory = a.subcategory
  LEFT JOIN af ON af.article_id = f.article_id LEFT JOIN pr ON pr.impression_id = f.impression_id LEFT JOIN vec ON vec.article_id = f.article_id LEFT JOIN ul ON ul.impression_id = f.impression_id)""",
)
_LAST_SCORES = """t AS (SELECT impression_id, candidate_article_id article_id, CASE WHEN isnan(bm25_score) THEN NULL ELSE bm25_score END b, CASE WHEN isnan(fusion_score) THEN NULL ELSE fusion_score END f, scored_at FROM candidate_features
  QUALIFY row_number() OVER (PARTITION BY impression_id, candidate_article_id ORDER BY scored_at DESC NULLS LAST, b DESC NULLS LAST, f DESC NULLS LAST) = 1)"""


def uniform_sql(row: str, draw: str) -> str:
    a = f"((({row} % 2147483647) * 48271 + CAST({draw} AS BIGINT) * 69621 + 42) % 2147483647)"
    b = f"(({a} * 16807) % 2147483647)"
    return f"(((({b} * {b}) % 2147483647) * 48271 + {a}) % 2147483647)"


SQL = {
    "popularity_rank": with_(IMP, CND, _POP) + "SELECT * FROM pop",
    "rank_lines": with_(IMP, CND, _POP) + "SELECT impression_id, concat(impression_id, ' [', string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos), ']') line FROM pop GROUP BY 1",
    "article_features": with_(ART, IMP, CND, _AF) + "SELECT * REPLACE (round(train_ctr, 6) AS train_ctr) FROM af",
    "user_features_cutoff": with_(IMP, CND) + """, k AS (SELECT min(impression_time) cut FROM imp WHERE split = 'val')
SELECT user_id, count(*) n_clicks, count(DISTINCT article_id) n_articles, round(date_diff('microsecond', max(impression_time), max(cut)) / 3.6e9, 6) recency_hours, round(date_diff('microsecond', min(impression_time), max(impression_time)) / 8.64e10, 6) tenure_days
FROM cnd, k WHERE label = 1 AND user_id IS NOT NULL AND impression_time < cut GROUP BY 1""",
    "click_history": with_(IMP, CND) + "SELECT user_id, article_id, impression_time click_time, split FROM cnd WHERE label = 1 AND user_id IS NOT NULL AND impression_time IS NOT NULL",
    "split_boundaries": with_(IMP) + "SELECT split, min(impression_time) first_time, max(impression_time) last_time, count(*) n_rows FROM imp GROUP BY 1",
    "first_seen_freshness": with_(IMP, CND, _SEEN, _FRESH.format(since="fs", join="")) + f"SELECT impression_id, pos, article_id, round({_DAYS}, 6) days_since FROM fr",
    "history_recent_weights": with_(IMP, HIST) + "SELECT impression_id, article_id, hpos, round(weight, 6) weight FROM hst",
    "category_match": with_(ART, IMP, CND, HIST, _CAT) + "SELECT c.impression_id, pos, c.article_id, round(coalesce(share, 0.0), 6) history_category_match FROM cnd c LEFT JOIN art a USING (article_id) LEFT JOIN sh ON sh.impression_id = c.impression_id AND sh.category = a.category",
    "session_prior_clicks": with_(IMP, _PRIOR) + "SELECT impression_id, CAST(pc AS BIGINT) session_prior_click_count FROM pr",
    "prior_engagement_mean": with_(IMP, _PRIOR) + "SELECT impression_id, round(rt, 6) user_avg_past_read_time, round(sp, 6) user_avg_past_scroll_pct FROM pr",
    "prior_engagement_mean_legacy": with_(IMP, _PRIOR) + "SELECT impression_id, round(CASE WHEN lrt IS NOT NULL THEN rt END, 6) user_avg_past_read_time, round(CASE WHEN lsp IS NOT NULL THEN sp END, 6) user_avg_past_scroll_pct FROM pr",
    "subcategory_match": with_(ART, IMP, CND, HIST, _SUB) + "SELECT c.impression_id, pos, c.article_id, round(coalesce(sub_share, 0.0), 6) history_subcategory_match FROM cnd c LEFT JOIN art a USING (article_id) LEFT JOIN ss ON ss.impression_id = c.impression_id AND ss.subcategory = a.subcategory",
    "candidate_features": with_(*_BUILT_FROM) + """
SELECT impression_id, article_id, label, split, candidate_position, history_length, round(history_category_match, 6) history_category_match, round(history_subcategory_match, 6) history_subcategory_match, round(history_embedding_sim, 5) history_embedding_sim,
  round(train_ctr, 6) train_ctr, train_impressions, round(article_days_since_publish, 6) article_days_since_publish, session_prior_click_count, round(user_avg_past_read_time, 6) user_avg_past_read_time, round(user_avg_past_scroll_pct, 6) user_avg_past_scroll_pct FROM built""",
    "assembled_features": with_(*_BUILT_FROM, _LAST_SCORES) + """
SELECT impression_id, article_id, candidate_position, label, split, history_length, round(history_category_match, 6) history_category_match, train_impressions, round(article_days_since_publish, 6) article_days_since_publish, session_prior_click_count,
  CAST(CAST(b AS FLOAT) AS DOUBLE) bm25_score, CAST(CAST(f AS FLOAT) AS DOUBLE) fusion_score
FROM (SELECT * FROM built QUALIFY row_number() OVER (PARTITION BY impression_id, article_id ORDER BY candidate_position) = 1) JOIN t USING (impression_id, article_id)""",
    "assembly_losses": with_(IMP, CND, _LAST_SCORES) + """, c AS (SELECT DISTINCT impression_id, article_id, split, true shown FROM cnd), u AS (SELECT impression_id, article_id, true scored FROM t WHERE impression_id IS NOT NULL AND article_id IS NOT NULL)
SELECT coalesce(split, 'none') split, count(*) FILTER (shown AND scored IS NULL) not_scored, count(*) FILTER (shown IS NULL) not_shown, count(*) FILTER (shown AND scored) joined FROM c FULL JOIN u USING (impression_id, article_id) GROUP BY 1""",
    "feature_score_join": with_(IMP, CND, _LAST_SCORES) + """
SELECT impression_id, article_id, pos, label, CAST(CAST(b AS FLOAT) AS DOUBLE) bm25_score, CAST(CAST(f AS FLOAT) AS DOUBLE) fusion_score FROM cnd JOIN t USING (impression_id, article_id)""",
    "profile_summary": with_(IMP) + "SELECT split, count(*) n, count(DISTINCT user_id) n_users, count(*) FILTER (user_id IS NULL) null_users, min(impression_time) first_time, max(impression_time) last_time, round(avg(len(hist)), 6) mean_history, min(len(hist)) min_history, max(len(hist)) max_history, CAST(quantile_cont(len(hist), 0.5) AS DOUBLE) median_history, round(avg(len(toks)), 6) mean_shown FROM imp GROUP BY 1",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' column_name, count(*) FILTER ({c} IS NULL) n_null, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) pct_null FROM behaviors" for c in _NULLABLE),
    "value_counts": with_(ART) + "SELECT category, count(*) n FROM art GROUP BY 1",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(avg(value), 6) mean, round(max(value), 6) top FROM events WHERE value IS NOT NULL GROUP BY 1",
    "set_union_dedupe": with_(ART, IMP, CND) + "SELECT article_id, 'catalogue' source FROM art UNION ALL SELECT DISTINCT article_id, 'shown' FROM cnd WHERE article_id NOT IN (SELECT article_id FROM art)",
    "intersect_except": with_(IMP, CND) + "(SELECT article_id, 'both' part FROM (SELECT article_id FROM cnd WHERE split = 'train' INTERSECT SELECT article_id FROM cnd WHERE split = 'test')) UNION ALL (SELECT article_id, 'test only' FROM (SELECT article_id FROM cnd WHERE split = 'test' EXCEPT SELECT article_id FROM cnd WHERE split = 'train'))",
    "negative_sampling": with_(IMP, CND) + f""", ng AS (SELECT *, count(*) OVER (PARTITION BY impression_id) m FROM (SELECT impression_id, article_id, row_number() OVER (PARTITION BY impression_id ORDER BY {uniform_sql("impression_id", "pos")}, pos) r FROM cnd WHERE label = 0) WHERE r <= 4)
SELECT p.impression_id, p.pos, p.article_id pos_article, CAST(s.slot AS INTEGER) slot, ng.article_id neg_article FROM cnd p, range(1, 5) s(slot), ng WHERE p.label = 1 AND ng.impression_id = p.impression_id AND ng.r = (s.slot - 1) % ng.m + 1""",
    "sampled_impressions": with_(IMP) + f"SELECT impression_id, split FROM imp ORDER BY {uniform_sql('impression_id', '0')}, impression_id LIMIT 200",
    "user_sessions_streamable": """WITH e AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 1800000000 THEN 0 ELSE 1 END c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) n, min(ts) first_ts, max(ts) last_ts FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) s FROM e) GROUP BY user_id, s""",
}
