"""Scores by tasks that hold the index whole, against the joins; no broadcast of exploded terms."""

import random

import pytest

from newsloom.operators import bm25f, recommend, semantic, whole
from newsloom.operators.recommend import Index
from newsloom.shared import materialize

ARTS = [
    ("a1", "red fox runs", "the fox", ["E1", "E2", "E1"]), ("a2", "blue fox", "the red sea", ["E1", None]), ("a3", "sea and fox", None, []), ("a4", "blue sea runs", "red", ["E9"]),
    ("a5", None, None, ["E2"]), ("a6", "unheard", "of", None),
]
INTER = [
    (1, ["a1", "a2", "gone", "a1"], ["a2", "a3", "a2", "new"], [1, 0, None, 0]), (2, [], ["a1", "a4"], [0, 1]), (3, ["a5"], ["a1"], [1]), (4, ["a1"], [], []), (5, None, ["a6", "a5"], [0, 0]),
    (6, [f"a{k % 6 + 1}" for k in range(45)], [f"a{k}" for k in (6, 5, 4, 3, 2, 1)], [0, 0, 1, 0, 0, 0]), (7, ["gone"], ["a1", "a3"], [None, None]),
]


def _tables(spark):
    a = spark.createDataFrame(ARTS, "article_id string, title string, abstract string, entities array<string>")
    i = spark.createDataFrame(INTER, "impression_id long, history_ids array<string>, candidate_ids array<string>, labels array<int>")
    v = spark.createDataFrame([(f"a{k}", [float(k), 1.0, -0.5 * k * k]) for k in (1, 2, 3, 5)] + [("a4", [0.0, 0.0, 0.0])], "article_id string, vec array<double>")
    cfg = bm25f.Bm25f(max_df=0.9)
    return i, Index(a, materialize(bm25f.postings(a, cfg), "postings"), materialize(v, "vectors"))


@pytest.mark.parametrize("places", [4_000_000, 1])
def test_whole_index_scores_as_joins_do(spark, places, monkeypatch):
    monkeypatch.setattr(whole, "PLACES", places)
    i, index = _tables(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got, want = ({(r.impression_id, r.pos): r for r in recommend.retrieval_scores(i.repartition(2), index, 0.6, 1.5, most).collect()} for most in (10**6, 0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(got) == set(want) == {(r[0], p + 1) for r in INTER for p in range(len(r[2]))}
    for k, r in want.items():
        assert (got[k].article_id, got[k].label) == (r.article_id, r.label)
        assert [got[k][s] for s in recommend.SCORES] == pytest.approx([r[s] for s in recommend.SCORES], abs=2e-9), k
    assert any(r.bm25_score for r in got.values()) and any(r.semantic_score for r in got.values())


def test_whole_index_without_vectors_or_postings(spark):
    i, index = _tables(spark)
    for empty in ({"vectors": index.vectors.limit(0)}, {"postings": index.postings.limit(0)}):
        some = Index(**{"articles": index.articles, "postings": index.postings, "vectors": index.vectors} | empty)
        got, want = (sorted((r.impression_id, r.pos, *(round(r[s], 8) + 0.0 for s in recommend.SCORES)) for r in recommend.retrieval_scores(i, some, most=most).collect()) for most in (10**6, 0))
        assert got == want


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search_of_whole_index_as_in_blocks(spark, k):
    r = random.Random(3)
    terms = spark.createDataFrame([(i, f"t{t}", r.choice([0.5, 1.0])) for i in range(40) for t in r.sample(range(30), r.randrange(1, 8))] + [(999, "unknown", 1.0)], "impression_id long, term string, qw double")
    index = spark.createDataFrame([(f"a{i}", f"t{t}", r.choice([0.25, 1.0])) for i in range(60) for t in r.sample(range(35), r.randrange(0, 6))], "article_id string, term string, weight double")
    got, want = (sorted((x.impression_id, x["rank"], x.article_id, round(x.score, 9)) for x in d.collect()) for d in (whole.search_top(terms, index, k), bm25f.search_top(terms, index, k)))
    assert got == want and got
    assert whole.search_top(terms.limit(0), index, k).count() == 0 == whole.search_top(terms, index.limit(0), k).count()


def test_exploded_terms_are_never_broadcast(spark):
    i, index = _tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        terms = bm25f.query_terms(i, index.articles)
        plans = {"terms": terms, "all": bm25f.score_all(terms, index.postings), "entities": bm25f.query_entities(i, index.articles)}
        for name, d in plans.items():
            assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString(), name
        stats = bm25f.field_stats(index.articles, bm25f.Bm25f())._jdf.queryExecution().executedPlan().toString()
        assert stats.count("SortMergeJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ranks_of_clicks_as_in_the_lists(spark):
    """Every place in the lists of both searches, from the whole index: ties, unknown articles, no history."""
    i, index = _tables(spark)
    ids = [a[0] for a in ARTS] + ["gone"]
    q = i.selectExpr("impression_id", "history_ids", f"array({','.join(repr(x) for x in ids)}) AS wanted")
    got = whole.ranks(q, whole.ship(index.postings, None, index.vectors), step=2).collect()
    assert len(got) == len(INTER) * len(ids)
    found = {
        "bm25": bm25f.search_top(materialize(bm25f.query_terms(i, index.articles), "terms"), index.postings, 1000),
        "semantic": semantic.search_top(semantic.user_vectors(i, index.vectors), index.vectors, 1000),
    }
    for m, lists in found.items():
        want = {(r.impression_id, r.article_id): r["rank"] for r in lists.collect()}
        assert {(r.impression_id, r.article_id): r[m] for r in got if r[m] is not None} == want and want, m


def test_ranking_tasks_stay_several_after_a_join(spark):
    i, index = _tables(spark)
    few = i.select("impression_id", "history_ids").join(i.selectExpr("impression_id", "array('a1') AS wanted").hint("merge"), "impression_id")
    d = whole.ranks(few, whole.ship(index.postings, None, index.vectors))
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("rows", [1, 10**6])
def test_scores_of_the_whole_corpus_without_shuffling_them(spark, rows, monkeypatch):
    monkeypatch.setattr(whole, "BATCH", rows)
    i, index = _tables(spark)
    terms = materialize(bm25f.query_terms(i, index.articles), "terms")
    d = whole.score_all(terms, index.postings)
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r.impression_id, r.article_id): r.score for r in x.collect()} for x in (d, bm25f.score_all(terms, index.postings)))
    assert got == pytest.approx(want) and got
    assert whole.score_all(terms.limit(0), index.postings).count() == 0 == whole.score_all(terms, index.postings.limit(0)).count()
