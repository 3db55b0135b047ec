"""Index, scores, search, predictions and reports against brute force; queries that do whole jobs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from newsloom.functions import vectors
from newsloom.operators import bm25f, metrics, recommend, resample, semantic
from newsloom.operators.recommend import Index
from newsloom.shared import materialize, new_path


def _queries_and_index(spark, seed=1, n_queries=40, n_articles=60, terms=30):
    r = random.Random(seed)
    q = [(i, f"t{t}", r.choice([0.5, 1.0, 2.0])) for i in range(n_queries) for t in r.sample(range(terms), r.randrange(1, 8))]
    a = [(f"a{i:03}", f"t{t}", r.choice([0.25, 1.0, 3.0])) for i in range(n_articles) for t in r.sample(range(terms + 5), r.randrange(0, 6))]
    q += [(999, "unknown", 1.0)]
    return q, a, spark.createDataFrame(q, "impression_id long, term string, qw double"), spark.createDataFrame(a, "article_id string, term string, weight double")


@pytest.mark.parametrize("queries,articles", [(1024, 8192), (7, 11), (1, 1)])
def test_search_in_blocks(spark, queries, articles):
    q, a, terms, index = _queries_and_index(spark)
    got = {}
    for r in bm25f.search_top(terms, index, 5, queries, articles).collect():
        got.setdefault(r.impression_id, []).append((r["rank"], r.article_id, r.score))
    weight = {}
    for art, t, w in a:
        weight.setdefault(t, []).append((art, w))
    want = {}
    for i, t, qw in q:
        for art, w in weight.get(t, ()):
            want.setdefault(i, {}).setdefault(art, 0.0)
            want[i][art] += qw * w
    best = {i: [(k + 1, art, s) for k, (art, s) in enumerate(sorted(d.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5])] for i, d in want.items()}
    assert {i: [x[:2] for x in sorted(v)] for i, v in got.items()} == {i: [x[:2] for x in v] for i, v in best.items()}
    every = {(r.impression_id, r.article_id): r.score for r in bm25f.score_all(terms, index).collect()}
    assert every == pytest.approx({(i, art): s for i, d in want.items() for art, s in d.items()})


def test_search_in_slices(monkeypatch):
    q = np.repeat(np.arange(50), 3)
    for most in (1, 40, 10_000):
        parts = list(bm25f._parts(q, np.full(150, 4), 5, most))
        assert [k for p in parts for k in range(p.start, p.stop)] == list(range(150)) and all(p.start % 3 == 0 for p in parts)


def test_search_of_nothing(spark):
    _, _, terms, index = _queries_and_index(spark)
    assert bm25f.search_top(terms.limit(0), index, 5).count() == 0 == bm25f.search_top(terms, index.limit(0), 5).count()


def _arts(spark):
    rows = [("a1", "red fox runs", "the fox", ["E1", "E2"]), ("a2", "blue fox", "the red sea", ["E1"]), ("a3", "sea and fox", None, []), ("a4", "blue sea runs", "red", ["E9"])]
    return spark.createDataFrame(rows, "article_id string, title string, abstract string, entities array<string>")


def test_projection_of_new_texts(spark):
    arts = _arts(spark)
    lsa = semantic.Lsa(size=3, rounds=3)
    fitted = {r.article_id: np.array(r.vec) for r in lsa.fit(arts).collect()}
    root = new_path(spark, "lsa")
    lsa.save(spark, root)
    for model in (lsa, semantic.Lsa.load(spark, root)):
        new = arts.unionByName(spark.createDataFrame([("n1", "red fox runs", "the fox", None), ("n2", "words unheard of", None, None)], arts.schema))
        got = {r.article_id: np.array(r.vec) for r in model.project(new).collect()}
        assert set(got) == {*fitted, "n1"}
        assert all(np.allclose(got[k], v) for k, v in fitted.items()) and np.allclose(got["n1"], fitted["a1"])


def test_index_with_each_backend(spark):
    arts = _arts(spark)
    vecs = spark.createDataFrame([(f"a{k}", [float(k), 1.0]) for k in range(1, 5)], "article_id string, vec array<double>")
    ents = spark.createDataFrame([("E1", [1.0, 0.0]), ("E2", [0.0, 1.0])], "entity_id string, vec array<double>")
    made = {
        "lsa": recommend.build_index(arts, "lsa", size=2), "vectors": recommend.build_index(arts, "vectors", vectors=vecs, entity_vecs=ents),
        "encoder": recommend.build_index(arts, "encoder", encoder=lambda ts: [[float(len(t)), 1.0] for t in ts], size=2),
    }
    got = {r.article_id: r.vec for r in made["vectors"].vectors.collect()}
    assert len(got["a1"]) == 4 and np.allclose(got["a1"][2:], np.array([1, 1]) / 2) and np.allclose(got["a4"][2:], 0)
    assert {r.article_id: r.vec[0] for r in made["encoder"].vectors.collect()}["a3"] == len("sea and fox")
    root = new_path(spark, "index")
    made["vectors"].save(spark, root)
    again = Index.load(spark, root)
    assert again.config["backend"] == "vectors" and again.postings.count() == made["vectors"].postings.count() > 0
    with pytest.raises(ValueError):
        recommend.build_index(arts, "encoder")


def test_report_against_single_intervals(spark):
    r = random.Random(2)
    rows = [(m, i, r.random() if r.random() < 0.9 else None, r.random()) for m in ("x", "y") for i in range(80)]
    per = spark.createDataFrame(rows, "method string, impression_id long, auc double, mrr double")
    got = {(x.method, x.metric): x for x in resample.intervals(per, ("auc", "mrr"), ("method",), n_boot=100).collect()}
    for m in ("x", "y"):
        for v in ("auc", "mrr"):
            one = resample.mean_interval(per.where(F.col("method") == m), v, n_boot=100).first()
            assert (got[m, v].mean, got[m, v].lo, got[m, v].hi) == pytest.approx((one["mean"], one.lo, one.hi)) and got[m, v].n == one.n
    slices = spark.createDataFrame([(i, "cold" if i < 30 else "warm") for i in range(80)], "impression_id long, slice string")
    d = {(x.slice, x.metric): x for x in recommend.before_after(per, slices, "x", "y", 100, ("auc", "mrr")).collect()}
    assert {k[0] for k in d} == {"overall", "cold", "warm"} and d["overall", "mrr"].n == 80 and d["cold", "mrr"].n == 30
    a, b = ({i: v for m, i, _, v in rows if m == x} for x in "xy")
    assert d["overall", "mrr"].delta == pytest.approx(np.mean([b[i] - a[i] for i in range(80)]))
    best = recommend.better_method(spark.createDataFrame([("x", 1, 0.5), ("y", 1, 0.5), ("x", 2, 0.1), ("y", 2, 0.2)], "method string, k int, recall double"), "recall", ("k",)).collect()
    assert {(x.method, x.k) for x in best if x.better} == {("x", 1), ("y", 2)}


def test_lists_of_vectors_are_reduced_in_order(spark):
    rows = [(k, p, 1.0 + p, [float(k), float(p)]) for k in range(40) for p in range(k % 5 + 1)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "impression_id long, hpos long, weight double, vec array<double>")
    u = {r.impression_id: r.user_vec for r in semantic.reduce_lists(d.select("impression_id", F.col("hpos").alias("ord"), F.col("weight").alias("w"), "vec"), "impression_id", "test", "user_vec", "array<double>", lambda w, m, f: semantic.as_lists(semantic._unit_means(w, m, f))).collect()}
    for k in range(40):
        w = np.array([1.0 + p for p in range(k % 5 + 1)])
        m = np.array([[k, p] for p in range(k % 5 + 1)], dtype=float)
        v = (m * w[:, None]).sum(0) / w.sum()
        assert np.allclose(u[k], v / (np.linalg.norm(v) or 1.0))


def test_sums_of_vectors_over_batches(spark):
    r = random.Random(7)
    rows = [(r.choice(["hot", "hot", *(f"k{k}" for k in range(30))]), r.random(), [r.random(), r.random()]) for _ in range(3000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        d = spark.createDataFrame([*rows, (None, 1.0, [1.0, 1.0])], "k string, w double, vec array<double>").repartition(5)
        got = {x.k: x.vec for x in vectors.sum_vectors(d, "k").collect()}
        assert vectors.sum_vectors(d.limit(0), "k").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for k, w, v in rows:
        want[k] = want.get(k, 0) + w * np.array(v)
    assert set(got) == set(want) and all(np.allclose(got[k], v) for k, v in want.items())


def test_recall_counts_indexed_truth_alone(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "gone"), (2, "gone")], "impression_id long, article_id string")
    found = spark.createDataFrame([(1, "a", 3)], "impression_id long, article_id string, rank int")
    known = spark.createDataFrame([("a",)], "article_id string")
    assert {(r.impression_id, r.k): r.recall for r in metrics.recall_at(truth, found, (2, 5), known).collect()} == {(1, 2): 0.0, (1, 5): 1.0}
    assert metrics.recall_at(truth, found, (5,)).where("impression_id = 2").first().recall == 0.0


def test_queries_cover_all_candidates(spark, sf):
    q = e.queries()
    every = materialize(e.feature_queries.cands(spark, sf), "every")
    n = every.count()
    for name in ("bm25f_restricted", "entity_boost", "cosine_candidates", "retrieval_scores", "candidate_features"):
        assert q[name](spark, sf).count() == n, name
    f = q["candidate_features"](spark, sf)
    assert f.where("history_embedding_sim <> 0").count() and f.where("history_subcategory_match <> 0").count()
    size = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.size("embedding")).first()[0]
    assert q["entity_fusion"](spark, sf).groupBy("article_id").count().where(F.col("count") != 2 * size).count() == 0


def test_reports_hold_every_method_slice_and_metric(spark, sf):
    q = e.queries()
    report = q["evaluation_report"](spark, sf).collect()
    assert {r.method for r in report} == set(recommend.SCORES) and {r.slice for r in report} >= {"overall"} and {r.metric for r in report} == {*recommend.SIX, "coverage"}
    assert all(r.lo <= r["mean"] <= r.hi for r in report if r.metric != "coverage" and r.n > 5)
    lines = q["prediction_pass"](spark, sf).groupBy("method").count().collect()
    assert len(lines) == 3 and len({r["count"] for r in lines}) == 1
    grid = q["bm25_grid"](spark, sf).collect()
    assert len(grid) == 20 and [r.auc for r in grid if r.best] == [max(r.auc for r in grid)]


def test_ablation_of_all_groups(spark, sf, monkeypatch):
    lq = e.learning_queries
    seen = []
    monkeypatch.setattr(lq.learn, "ablation", lambda *a, **k: seen.append((a[2], k)) or spark.createDataFrame([], "variant string, mean double, drop double, lo double, hi double, n long, excludes_zero boolean"))
    lq.feature_ablation(spark, sf)
    assert seen == [(lq.GROUPS, {})] and [f for fs in seen[0][0].values() for f in fs] == list(lq.FEATURES)
