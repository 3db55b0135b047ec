"""Top n and rank fusion, against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import rrf, topn
from newsloom.llm.rrf import reciprocal_rank_fusion
from newsloom.llm.topn import top_n
from newsloom.shared import materialize, new_path

SC = "impression_id long, candidate_article_id string, a double, b double, c double, candidate_position int, scored_at long"
KEYS = ("impression_id", "candidate_article_id")


def _rows(seed, groups=40, hot=400):
    r = random.Random(seed)
    score = lambda: r.choice([None, float("nan"), 0.0, -0.0, 1.0, 1.0, r.random(), r.gauss(0, 1e6)])
    rows = []
    for g in list(range(groups)) + [None]:
        for i in range(hot if g == 0 else r.randrange(0, 12)):
            rows.append((g, r.choice([f"x{i}", f"x{i}", None]), score(), score(), score(), r.choice([None, i]), r.choice([1, 2, None])))
    rows += rows[:30]
    rows += [(g, i, score(), score(), score(), p, 3) for g, i, _, _, _, p, _ in rows[40:60]]
    return rows


def _num(x):
    return None if x is None or math.isnan(x) else x


def _add(v):
    return ((v[0] or 0.0) + (v[1] or 0.0)) + (v[2] or 0.0)  # from left to right, unlike sum()


def _latest(rows, cols):
    best = {}
    low = lambda x: (0, 0.0) if x is None else (1, x)
    for g, i, *s, p, v in rows:
        if g is None or i is None:
            continue
        vals = [_num(s[c]) for c in cols]
        key = (low(v), [low(x) for x in vals], -(p if p is not None else 10**9))
        if (g, i) not in best or key > best[g, i][0]:
            best[g, i] = (key, vals, p)
    out = defaultdict(list)
    for (g, i), (_, vals, p) in best.items():
        out[g].append((i, vals, p if p is not None else 10**9))
    return out


@pytest.mark.parametrize("n,bands,broadcast_rows", [(5, (0.5, 0.75, 0.875), 1000), (3, (), 1000), (1000, (0.5,), 1000), (2, (0.3, 0.6, 0.9), 5), (2, (0.3, 0.6, 0.9), 0)])
def test_top_n(spark, n, bands, broadcast_rows):
    rows = _rows(1)
    d = spark.createDataFrame(rows, SC).withColumn("g", F.lit("x")).withColumn("r", F.lit(1)).withColumn("band", F.lit(1))
    got = sorted((r.impression_id, r["rank"], r.candidate_article_id) for r in top_n(d, *KEYS, "a", n, "candidate_position", "scored_at", bands, broadcast_rows).collect())
    want = []
    for g, items in _latest(rows, [0]).items():
        best = sorted((-v[0], p, i) for i, v, p in items if v[0] is not None)[:n]
        want += [(g, k + 1, i) for k, (_, _, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_filled_groups_leave_before_ranking(spark, broadcast_rows):
    """The anti-join stands below the window, and rows of filled groups never reach the sort."""
    rows = spark.range(20_000).select((F.col("id") % 40).alias("g"), F.col("id").cast("string").alias("i"), F.rand(3).alias("s"), F.lit(None).cast("long").alias("p"))
    path = new_path(spark, "rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    top = materialize(topn.rank_band(rows.where("s >= 0.9"), [], rows, 5, broadcast_rows), "top")
    low = rows.where("s < 0.9").unionByName(spark.createDataFrame([(99, f"y{k}", 0.1 * k, None) for k in range(9)], rows.schema))
    everyone = low.unionByName(rows)
    left = topn.unfilled(low, top.groupBy("g").agg(F.count(F.lit(1)).alias("taken")), everyone, 5, broadcast_rows)
    assert left.count() == 9
    ranked = topn.rank_band(low, [top], everyone, 5, broadcast_rows)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    window, join = plan.index("Window"), plan.index("LeftAnti" if broadcast_rows else "__bits")
    assert window < join, plan
    assert {(r.i, r.r) for r in ranked.collect()} == {(f"y{8 - k}", k + 1) for k in range(5)}


def test_top_n_empty_and_unscored(spark):
    d = spark.createDataFrame(_rows(1), SC)
    assert top_n(d.limit(0), *KEYS, "a").count() == 0
    assert top_n(d.withColumn("a", F.lit(None).cast("double")), *KEYS, "a").count() == 0


@pytest.mark.parametrize("group_rows,broadcast_rows", [(10_000, 100), (50, 100), (50, 0), (5, 1)])
def test_fusion(spark, group_rows, broadcast_rows):
    """The same result whether the large group is ranked whole or by ranges."""
    rows = _rows(2)
    d = spark.createDataFrame(rows, SC).withColumn("g", F.lit("x")).withColumn("s0", F.lit(1)).withColumn("rrf", F.lit(1))
    got = {(r.impression_id, r.candidate_article_id): r for r in reciprocal_rank_fusion(d, *KEYS, ("a", "b", "c"), "candidate_position", "scored_at", group_rows=group_rows, broadcast_rows=broadcast_rows).collect()}
    n = 0
    for g, items in _latest(rows, [0, 1, 2]).items():
        want = []
        top = max(_add(v) for _, v, _ in items)
        for i, v, p in items:
            ranks = [None if x is None else sum(1 for _, w, _ in items if w[c] is not None and w[c] >= x) for c, x in enumerate(v)]
            want.append((-round(sum(1.0 / (k + 60) for k in ranks if k), 12), p, i, ranks, _add(v)))
        want.sort()
        for pos, (s, _, i, ranks, plain) in enumerate(want, 1):
            r = got[g, i]
            assert [r.rank_a, r.rank_b, r.rank_c] == ranks and r.position == pos
            assert math.isclose(r.rrf_score, -s, abs_tol=1e-9) and r.plain_sum == plain and r.top_sum == top
            n += 1
    assert n == len(got)


def test_hot_ties_and_empty(spark):
    tied = [(1, f"x{i:04}", 1.0, None, float("nan"), None, 1) for i in range(300)]
    d = spark.createDataFrame(tied, SC)
    out = reciprocal_rank_fusion(d, *KEYS, ("a", "b", "c"), "candidate_position", "scored_at", group_rows=50).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 301)) and {r.rank_a for r in out} == {300} and {r.rank_b for r in out} == {None}
    assert [r.candidate_article_id for r in out] == sorted(x[1] for x in tied)
    assert reciprocal_rank_fusion(d.limit(0), *KEYS, ("a", "b", "c")).count() == 0


def test_no_task_sorts_a_large_group(spark, monkeypatch):
    """Windows of whole groups see no row of a large one; its rows are joined by value apart from those
    whose value is common or missing."""
    n = 3000
    d = spark.createDataFrame([(1, f"x{i}", 0.0 if i % 3 else 1.0 * i, None, 2.0, i, 1) for i in range(n)] + [(2, "y", 1.0, 1.0, 1.0, 1, 1)], SC)
    small, joined = [], []
    whole, ranked = rrf._small_groups, rrf._with_rank
    monkeypatch.setattr(rrf, "_small_groups", lambda d, *a: small.append(d.count()) or whole(d, *a))

    def with_rank(d, j, *a):
        out = ranked(d, j, *a)
        joined.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(rrf, "_with_rank", with_rank)
    out = reciprocal_rank_fusion(d, *KEYS, ("a", "b", "c"), "candidate_position", "scored_at", group_rows=200).collect()
    assert small == [1] and len(out) == n + 1 and {r.rank_c for r in out} == {n, 1}
    assert len(joined) == 3 and all("Window" not in p and "__aside" in p for p in joined)
