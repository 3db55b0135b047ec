"""Exact per-key quantiles, against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.hot_keys import key_quantiles
from newsloom.shared import new_path


def _brute(rows, probs):
    out = {}
    for k, v in rows:
        if k is None:
            continue
        n, vals = out.setdefault(str(k), [0, []])
        out[str(k)][0] += 1
        if v is not None and not math.isnan(v):
            vals.append(v)
    return {k: (n, len(v), [sorted(v)[max(1, math.ceil(p * len(v))) - 1] for p in probs] if v else None) for k, (n, v) in out.items()}


def test_against_sorting(spark):
    random.seed(1)
    rows = [(7, random.gauss(0, 1)) for _ in range(3000)]  # a hot key
    rows += [(random.choice([1, 2, 3, None]), random.choice([0.0, -0.0, 5.5, 5.5, -3.0, None, float("nan"), random.random(), 1e300, -1e-300])) for _ in range(600)]
    rows += [(9, None)] * 3 + [(10, 4.0)] * 50
    d = spark.createDataFrame(rows, "key_value long, v double").withColumn("b", F.lit(1)).withColumn("k", F.lit("x"))
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r.key_value: (r.n_rows, r.n_values, r.quantiles) for r in key_quantiles(d, "key_value", "v", probs).collect()}
    want = _brute(rows, probs)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    for k, (_, _, q) in want.items():
        assert (got[k][2] or None) == q, k


@pytest.mark.parametrize("few_rows,broadcast_rows", [(4096, 200_000), (4, 200_000), (4, 0), (4096, 0)])
def test_all_ways_of_refining(spark, few_rows, broadcast_rows):
    r = random.Random(3)
    rows = [(1, r.gauss(1.7e9, 1e6)) for _ in range(2000)] + [(1, -r.random() * 1e-310) for _ in range(300)] + [(1, r.choice([2.0, math.nextafter(2.0, 3)])) for _ in range(500)]
    rows += [(k, r.choice([-1, 1]) * r.random() * 10 ** r.randrange(-3, 3)) for k in range(2, 60) for _ in range(r.randrange(1, 30))]
    probs = (0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0)
    d = spark.createDataFrame(rows, "k long, v double")
    got = {x.key_value: x.quantiles for x in key_quantiles(d, "k", "v", probs, few_rows=few_rows, broadcast_rows=broadcast_rows).collect()}
    assert got == {k: q for k, (_, _, q) in _brute(rows, probs).items()}
    some = {x.key_value: x.quantiles for x in key_quantiles(d, "k", "v", probs, min_share=0.1, few_rows=few_rows, broadcast_rows=broadcast_rows).collect()}
    assert some == {"1": got["1"]}


def test_a_hot_bin_is_shuffled_as_counts(spark):
    """Rows that reach an exchange: partial counts, not the values of the hot key."""
    n = 200_000
    d = spark.range(n).select(F.lit(1).alias("k"), (F.floor(F.rand(1) * 50) + 100).alias("v")).repartition(8)
    path = new_path(spark, "hot")
    d.write.parquet(path)
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    assert tracker is not None
    before = _shuffled(spark)
    assert key_quantiles(spark.read.parquet(path), "k", "v").first().n_rows == n
    assert _shuffled(spark) - before < n / 50


def _shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(spark.sparkContext._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_share_and_total_count_null_keys(spark):
    rows = [(1, 1.0)] * 50 + [(2, 2.0)] * 9 + [(None, 3.0)] * 41
    got = key_quantiles(spark.createDataFrame(rows, "k long, v double"), "k", "v", min_share=0.1).collect()
    assert [(r.key_value, r.n_rows, r.total_rows) for r in got] == [("1", 50, 100)]


def test_empty_and_infinite(spark):
    e = spark.createDataFrame([], "k string, v double")
    assert key_quantiles(e, "k", "v").count() == 0
    r = key_quantiles(spark.createDataFrame([("a", float("inf")), ("a", float("-inf")), ("a", 1.0)], "k string, v double"), "k", "v", (0.5,)).first()
    assert r.quantiles == [1.0]
