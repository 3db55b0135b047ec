"""Guards, leakage, histories, features, metrics and intervals on small fixtures."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text, vectors
from newsloom.operators import bm25f, features, guards, history, learn, metrics, ranking, resample, semantic
from newsloom.shared import materialize, new_path
from newsloom.sources import click_log, sinks

T0 = datetime(2031, 1, 1)
SEEN = "impression_id long, user_id long, session_id long, impression_time timestamp_ntz, read_time double, scroll_percentage double, n_clicked int"


def at(m):
    return T0 + timedelta(minutes=m)


def test_split_order(spark):
    mk = lambda rows: spark.createDataFrame(rows, "split string, impression_time timestamp_ntz")
    guards.assert_split_order(mk([("train", at(0)), ("train", at(5)), ("val", at(5)), ("test", at(9))]))
    with pytest.raises(AssertionError):
        guards.assert_split_order(mk([("train", at(6)), ("val", at(5))]))
    guards.assert_split_order(mk([("train", at(6)), ("test", None)]))


def test_cutoff_guard(spark):
    d = spark.createDataFrame([(at(1),), (at(2),)], "click_time timestamp_ntz")
    guards.assert_before_cutoff(d, at(3))
    with pytest.raises(AssertionError):
        guards.assert_before_cutoff(d, at(2))  # equality leaks


def test_aligned_and_feature_guards(spark):
    guards.assert_aligned(spark.createDataFrame([([1], [2])], "a array<int>, b array<int>"), "a", "b")
    with pytest.raises(AssertionError):
        guards.assert_aligned(spark.createDataFrame([([1], [2, 3])], "a array<int>, b array<int>"), "a", "b")
    with pytest.raises(AssertionError):
        guards.assert_same_features(["a"], ["b"])


def test_recent_weights(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["x"])], "impression_id long, history_ids array<string>")
    got = sorted((r.impression_id, r.article_id, round(r.weight, 4)) for r in history.recent_weights(d, 2).collect())
    assert got == [(1, "b", 0.85), (1, "c", 1.0), (3, "x", 1.0)]


def test_prior_figures_use_only_earlier_rows(spark):
    rows = [(1, 7, 1, at(0), 10.0, None, 1), (2, 7, 1, at(1), None, 5.0, 2), (3, 7, 1, at(2), 20.0, float("nan"), 0), (4, 7, 2, at(3), 5.0, 1.0, 1), (5, 8, 1, at(3), 99.0, 9.0, 0), (6, None, None, at(4), 1.0, 1.0, 1), (7, 7, 1, at(2), 1.0, 1.0, 1)]
    d = spark.createDataFrame(rows, SEEN)
    for spans, rows_each in ((1, 100), (3, 100), (64, 100), (3, 1), (1, 1)):
        got = {r.impression_id: (r.session_prior_click_count, r.user_avg_past_read_time, r.user_avg_past_scroll_pct) for r in history.prior_figures(d, spans=spans, period_rows=rows_each).collect()}
        assert got[1] == (0, None, None) and got[2] == (1, 10.0, None) and got[3] == (3, 10.0, 5.0)
        assert got[7] == (3, 15.0, 5.0)  # same time as 3: the id decides
        assert got[4] == (0, 31 / 3, 3.0) and got[5] == (4, None, None) and got[6] == (0, None, None)
    for spans, rows_each in ((64, 100), (1, 1), (1, 100)):
        legacy = {r.impression_id: r.user_avg_past_read_time for r in history.prior_figures(d, True, spans, rows_each).collect()}
        assert legacy[3] is None and legacy[7] == 15.0


def test_freshness_never_uses_the_future(spark):
    c = spark.createDataFrame([(1, "a", at(0), "train"), (2, "a", at(1440), "train"), (3, "b", at(2880), "train"), (4, "z", at(10), "val")], "impression_id long, article_id string, impression_time timestamp_ntz, split string")
    seen = features.first_seen(c.where("article_id <> 'z'"))
    got = {r.impression_id: r.days_since for r in features.freshness(c, seen).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}
    strict = {r.impression_id: r.days_since for r in features.freshness(c, seen, strict=True).collect()}
    assert strict == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0}
    pub = spark.createDataFrame([("b", at(0))], "article_id string, published_time timestamp_ntz")
    assert {r.impression_id: r.days_since for r in features.freshness(c, seen, pub).collect()}[3] == 2.0


def test_category_match_sums_to_one(spark):
    arts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "article_id string, category string")
    inter = spark.createDataFrame([(1, ["a", "b", "c", "b"]), (2, [])], "impression_id long, history_ids array<string>")
    dist = {r.category: r.share for r in features.category_distribution(inter, arts).collect()}
    assert math.isclose(sum(dist.values()), 1.0) and dist["y"] > dist["x"]
    c = spark.createDataFrame([(1, "a"), (1, "q"), (2, "a")], "impression_id long, article_id string")
    got = {(r.impression_id, r.article_id): r.history_category_match for r in features.category_match(c, inter, arts).collect()}
    assert got[1, "q"] == 0.0 == got[2, "a"] and math.isclose(got[1, "a"], dist["x"])


def test_user_features_stop_at_the_cutoff(spark):
    d = spark.createDataFrame([(1, "a", at(0)), (1, "b", at(60)), (1, "c", at(600))], "user_id long, article_id string, click_time timestamp_ntz")
    r = features.user_features(d, F.lit(at(120))).first()
    assert (r.n_clicks, r.n_articles, r.recency_hours) == (2, 2, 1.0)


def _metric(labels, scores, k):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    dcg = lambda ys: sum(y / math.log2(i + 2) for i, y in enumerate(ys[:k]))
    return dcg([labels[i] for i in order]) / dcg(sorted(labels, reverse=True))


def test_metrics_against_definitions(spark):
    r = np.random.default_rng(0)
    cases = {}
    for i in range(60):
        n = int(r.integers(1, 15))
        cases[i] = (r.integers(0, 2, n).tolist(), r.integers(0, 4, n).astype(float).tolist())
    rows = [(i, p + 1, y, s) for i, (ys, ss) in cases.items() for p, (y, s) in enumerate(zip(ys, ss))]
    got = {x.impression_id: x for x in metrics.impression_metrics(spark.createDataFrame(rows, "impression_id long, pos int, label int, s double"), "s").collect()}
    for i, (ys, ss) in cases.items():
        pos, neg = [s for y, s in zip(ys, ss) if y], [s for y, s in zip(ys, ss) if not y]
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert got[i].auc == pytest.approx(auc) if auc is not None else got[i].auc is None
        if not pos:
            assert got[i].mrr is None and got[i].ndcg5 is None
            continue
        order = sorted(range(len(ss)), key=lambda j: (-ss[j], j))
        assert got[i].mrr == pytest.approx(sum(1 / (k + 1) for k, j in enumerate(order) if ys[j]) / len(pos))
        assert got[i].ndcg5 == pytest.approx(_metric(ys, ss, 5)) and got[i].ndcg10 == pytest.approx(_metric(ys, ss, 10))


def test_diversity_equals_pairs(spark):
    v = np.random.default_rng(1).normal(size=(5, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(f"a{i}", x.tolist()) for i, x in enumerate(v)], "article_id string, vec array<double>")
    top = spark.createDataFrame([(1, i, f"a{i}") for i in range(5)] + [(2, 0, "a0")], "impression_id long, pos int, article_id string")
    got = {r.impression_id: r.diversity for r in metrics.diversity(top, vecs).collect()}
    assert got[1] == pytest.approx(1 - np.mean([v[i] @ v[j] for i in range(5) for j in range(i)])) and got[2] is None


def test_intervals(spark):
    v = np.random.default_rng(2).normal(3, 1, 400)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(999, None)], "impression_id long, m double")
    r = resample.mean_interval(d, "m", n_boot=300).first()
    se = v.std() / 20
    assert r.n == 400 and r.mean == pytest.approx(v.mean()) and abs((r.hi - r.lo) / (2 * 1.96 * se) - 1) < 0.25 and r.lo < r.mean < r.hi
    p = resample.paired_delta(d, d.withColumn("m", F.col("m") + 1), "m", n_boot=50).first()
    assert p.delta == pytest.approx(1.0) and p.excludes_zero
    same = resample.paired_delta(d, d, "m", n_boot=50).first()
    assert same.delta == 0.0 and not same.excludes_zero
    assert resample.mean_interval(d.limit(0), "m", n_boot=10).first().n == 0


def test_fusion_and_ranks(spark):
    d = spark.createDataFrame([(1, 1, 2.0, 5.0), (1, 2, 4.0, 5.0), (1, 3, 3.0, 5.0)], "impression_id long, pos int, a double, b double")
    f = {r.pos: r.fused for r in ranking.fuse_scores(d, "a", "b", 0.0, "fused").collect()}
    assert f == {1: 0.0, 2: 1.0, 3: 0.5}
    lines = ranking.rank_lines(ranking.ordinal_ranks(d, "a")).collect()
    assert [r.line for r in lines] == ["1 [3,1,2]"]


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    r = d.select(vectors.unit(F.col("a")).alias("u"), vectors.fuse(F.col("a"), F.col("b")).alias("f"), vectors.norm(F.col("a")).alias("n")).collect()
    assert r[0].u == [0.6, 0.8] and r[0].n == 5.0 and r[0].f == [0.6, 0.8, 0.0, 0.0]
    assert r[1].f == pytest.approx([0.5**0.5, 0.0, 0.0, 0.5**0.5])


def test_text(spark):
    d = spark.createDataFrame([("Ålborg rød 7", " a  b ", None)], "a string, b string, c string")
    r = d.select(text.tokens(F.col("a")).alias("t"), text.word_count(F.col("b")).alias("n"), text.word_count(F.col("c")).alias("z"), text.article_text(F.col("b"), F.col("c")).alias("x")).first()
    assert r.t == ["lborg", "r", "d", "7"] and r.n == 2 and r.z == 0 and r.x == " a  b "


def test_bm25f_against_formula(spark):
    docs = {"a": ("red fox", "the fox ran"), "b": ("red dog", ""), "c": (None, "fox dog dog")}
    arts = spark.createDataFrame([(k, *v, []) for k, v in docs.items()], "article_id string, title string, abstract string, entities array<string>")
    cfg = bm25f.Bm25f(max_df=1.0)
    toks = {k: [(t or "").split() for t in v] for k, v in docs.items()}
    df = {}
    for fs in toks.values():
        for t in set(fs[0] + fs[1]):
            df[t] = df.get(t, 0) + 1
    voc = {t for t, n in df.items() if n >= 2}
    lens = {k: [sum(t in voc for t in f) for f in fs] for k, fs in toks.items()}
    avg = [sum(x[i] for x in lens.values()) / 3 for i in (0, 1)]
    got = {(r.article_id, r.term): r.weight for r in bm25f.postings(arts, cfg).collect()}
    for k, fs in toks.items():
        for t in voc:
            f = sum(w * fs[i].count(t) / (1 - 0.75 + 0.75 * lens[k][i] / avg[i]) for i, w in ((0, 2.0), (1, 1.0)))
            if f:
                assert got.pop((k, t)) == pytest.approx(max(math.log((3 - df[t] + 0.5) / (df[t] + 0.5) + 1), 1e-6) * f * 2.5 / (f + 1.5))
    assert not got


def test_exact_search_over_blocks(spark):
    v = np.random.default_rng(3).normal(size=(60, 5))
    vecs = spark.createDataFrame([(f"a{i:02}", x.tolist()) for i, x in enumerate(v)], "article_id string, vec array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(7)], "impression_id long, user_vec array<double>")
    got = {(r.impression_id, r["rank"]): r.article_id for r in semantic.search_top(q, vecs, 4, block=10).collect()}
    for i in range(7):
        best = sorted(range(60), key=lambda j: (-round(v[i] @ v[j], 9), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == [f"a{j:02}" for j in best]


def test_lsa_keeps_the_main_space(spark):
    words = ["sun moon star sky", "sun star sky light", "ball goal team cup", "team goal cup match", "sun moon light", "ball match team"] * 2
    arts = spark.createDataFrame([(f"a{i}", w, "") for i, w in enumerate(words)], "article_id string, title string, abstract string")
    v = {r.article_id: np.array(r.vec) for r in semantic.Lsa(size=2, rounds=3).fit(arts).collect()}
    sky, sport = ["a0", "a1", "a4"], ["a2", "a3", "a5"]
    assert min(v[x] @ v[y] for g in (sky, sport) for x in g for y in g) > 0.9 and max(abs(v[x] @ v[y]) for x in sky for y in sport) < 0.3


def test_boosting_learns(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(150):
        x = r.normal(size=(6, 2))
        best = int(np.argmax(x[:, 0] - x[:, 1]))
        rows += [(i, j + 1, float(x[j, 0]), float(x[j, 1]) if j else None, int(j == best)) for j in range(6)]
    d = spark.createDataFrame(rows, "impression_id long, pos int, u double, w double, label int")
    fitted = learn.RankBoost(trees=6, depth=3, rate=0.3).fit(d.where("impression_id < 100"), ["u", "w"])
    val = d.where("impression_id >= 100")
    scored = fitted.predict(val)
    assert metrics.impression_metrics(scored, "model_score").agg(F.avg("auc")).first()[0] > 0.8
    path = new_path(spark, "model")
    fitted.save(spark, path)
    again = learn.RankBoost.load(spark, path)
    assert again == fitted and again.predict(val).collect() == scored.collect()
    with pytest.raises(FileNotFoundError):
        learn.RankBoost.load(spark, path + "-none")


def test_boosting_does_not_depend_on_storing(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, j, float(r.normal()), int(r.integers(0, 2))) for i in range(60) for j in range(5)]
    d = spark.createDataFrame(rows, "impression_id long, pos int, u double, label int")
    got = []
    for every, few in ((1, 64), (100, 64), (100, 0)):
        monkeypatch.setattr(learn, "STORE_EVERY", every)
        monkeypatch.setattr(learn, "FEW_TASKS", few)
        got.append([r.model_score for r in learn.RankBoost(trees=4, depth=2).fit(d, ["u"]).predict(d).orderBy("impression_id", "pos").collect()])
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2]) and len(set(got[0])) > 2


def test_encoder_gradients():
    r = np.random.default_rng(0)
    m = learn.Nrms({f"w{k}": k for k in range(2, 9)}, size=8, heads=2, title=5, seed=1)
    hist, shown = r.integers(0, 9, (3, 4, 5)), r.integers(1, 9, (3, 3, 5))
    hist[0, :2] = 0
    hist[2] = 0
    _, grad = m.gradients(hist, shown)
    for k, g in grad.items():
        for at in [tuple(r.integers(0, x) for x in g.shape) for _ in range(4)]:
            old, ends = m.w[k][at], []
            for step in (1e-5, -1e-5):
                m.w[k][at] = old + step
                ends.append(m.gradients(hist, shown)[0])
            m.w[k][at] = old
            assert np.isclose((ends[0] - ends[1]) / 2e-5, g[at], atol=1e-6), (k, at)


def test_encoder_learns_and_is_saved(spark):
    arts = spark.createDataFrame([(f"{t}{k}", f"{t} word{k} text") for t in ("sport", "music") for k in range(6)], "article_id string, title string")
    r = np.random.default_rng(3)
    rows = []
    for i in range(80):
        t, o = (("sport", "music"), ("music", "sport"))[i % 2]
        rows.append((i, [f"{t}{r.integers(6)}" for _ in range(3)], [f"{o}{r.integers(6)}", f"{t}{r.integers(6)}", f"{o}{r.integers(6)}"], [0, 1, 0]))
    rows += [(100, ["sport1"], ["sport1", "sport2"], [0, 0]), (101, ["sport1"], ["sport1"], [1]), (102, [], ["gone", "sport2"], [1, 0]), (103, [], ["music1"], [1, 0])]
    d = spark.createDataFrame(rows, "impression_id long, history_ids array<string>, candidate_ids array<string>, labels array<int>")
    m = learn.Nrms(learn.build_vocab(arts), size=8, heads=2, title=4)
    inst = materialize(learn.instances(d, arts, m, 2, 5), "instances")
    got = inst.collect()
    assert len(got) == 81 and all(len(x.hist) == 5 and len(x.shown) == 3 and len(x.shown[0]) == 4 for x in got)
    assert next(x for x in got if x.row.startswith("102-")).shown[0] == [0] * 4
    losses = m.fit(inst, epochs=6, batches=2, rate=0.02)
    assert losses[-1] < 0.5 * losses[0] and losses[0] > 0.5
    root = new_path(spark, "nrms")
    m.save(spark, root)
    again = learn.Nrms.load(spark, root)
    assert np.array_equal(again.titles(["sport word1"]), m.titles(["sport word1"]))


def test_attention_ignores_padding():
    m = learn.Nrms({"a": 2, "b": 3}, size=8, heads=2, title=4)
    one = m.titles(["a b", "a b"])
    assert np.allclose(one[0], one[1]) and np.allclose(learn.Nrms({"a": 2, "b": 3}, size=8, heads=2, title=9, weights=m.w).titles(["a b"])[0], one[0])
    assert np.allclose(m.users([one[:1]], 1), m.users([one[:1]], 5)) and np.allclose(m.titles([None]), 0.0)


def test_raw_files_and_sinks(spark, tmp_path):
    news = tmp_path / "news.tsv"
    ent = '[{"WikidataId": "Q1"}, {"WikidataId": "Q1"}, {"WikidataId": "Q2"}]'
    news.write_text(f"N1\tsport\tcup\tA \"title\"\tabs\thttp://x\t{ent}\tbroken\nN2\tnews\tx\tB\t\t\t[]\t[]\n")
    a = {r.article_id: r for r in click_log.articles_from_news(click_log.news_tsv(spark, str(news))).collect()}
    assert a["N1"].entities == ["Q1", "Q2"] and a["N1"].title == 'A "title"' and a["N2"].abstract is None
    beh = tmp_path / "b.tsv"
    beh.write_text("1\tU1\t11/15/2019 8:55:22 AM\tN1 N2\tN1-0 N2-1\n2\tU2\tbad\t\tN1-x N2\n")
    b = click_log.behaviors_tsv(spark, str(beh)).withColumnRenamed("id", "impression_id").withColumnRenamed("time", "impression_time")
    b = b.select("*", F.lit(None).cast("timestamp").alias("ingested_time"), F.lit(1).alias("session_id"), F.lit(0.0).alias("read_time"), F.lit(0.0).alias("scroll_percentage"), F.lit("train").alias("split"))
    i = {r.impression_id: r for r in click_log.interactions(b, prefix=True).collect()}
    assert i["train_1"].labels == [0, 1] and i["train_1"].impression_time == datetime(2019, 11, 15, 8, 55, 22)
    assert i["train_2"].candidate_ids == ["N2"] and i["train_2"].labels == [None] and i["train_2"].impression_time is None
    vec = tmp_path / "v.vec"
    vec.write_text("Q1\t" + "\t".join(["0.5"] * 100) + "\t\nQ2\t1\n")
    assert [(r.entity_id, len(r.vec)) for r in click_log.entity_vectors(spark, str(vec), str(vec)).collect()] == [("Q1", 100)]
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "ordinal long, line string")
    sinks.write_rank_file(lines, f"{tmp_path}/out", f"{tmp_path}/p.zip")
    import zipfile

    assert zipfile.ZipFile(f"{tmp_path}/p.zip").read("prediction.txt") == b"a\nb\n"
    root = f"file://{tmp_path}/index"
    sinks.save_index(spark, root, {"k1": 1.5}, postings=lines)
    cfg, tables = sinks.load_index(spark, root)
    assert cfg == {"k1": 1.5} and tables["postings"].count() == 2
    made = []
    for _ in range(2):
        sinks.table_for(spark, f"file://{tmp_path}", "t", {"a": 1}, lambda: made.append(1) or lines)
    assert len(made) == 1


def test_in_view_lists_and_clicks(spark):
    b = spark.createDataFrame([(1, 7, at(0), [1, 2], [2]), (2, 8, at(1), None, None)], "impression_id long, user_id long, impression_time timestamp_ntz, article_ids_inview array<long>, article_ids_clicked array<long>")
    h = spark.createDataFrame([(7, [5], [at(-9)])], "user_id long, article_id_fixed array<long>, impression_time_fixed array<timestamp_ntz>")
    i = {r.impression_id: r for r in click_log.inview_interactions(b, h, "val").collect()}
    assert i["val_1"].labels == [0, 1] and i["val_1"].history_ids == ["5"] and i["val_2"].candidate_ids == [] == i["val_2"].history_ids
    one = click_log.first_clicks(click_log.history_clicks(h, "train", 0), click_log.history_clicks(h, "val", 1)).collect()
    assert [(r.user_id, r.article_id, r.split) for r in one] == [(7, "5", "train")]
    raw = spark.createDataFrame([(1, "t", [3, 4], "cat")], "article_id int, title string, subcategory array<short>, category_str string")
    r = click_log.articles_from_parquet(raw).first()
    assert (r.article_id, r.subcategory, r.category, r.entities, r.abstract) == ("1", "3,4", "cat", [], None)


def test_every_query_runs_and_has_stable_columns(spark, sf):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q)
    assert e.entry(spark).columns == ["impression_id", "pos", "article_id", "clicks", "rank"]
    for n in ("popularity_rank", "recall_report", "bootstrap_coverage", "event_sessions_stream"):
        assert q[n](spark, sf).count() > 0
