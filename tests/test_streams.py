"""Streams on small files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators.sessions import SessionTable
from newsloom.streaming import sessions as s

T0 = datetime(2031, 1, 1)
SC = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def _write(spark, path, rows):
    spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, t) for i, m, u, t in rows], SC).coalesce(1).write.mode("append").parquet(path)


def test_sessions_from_several_files(spark, tmp_path):
    p = f"file://{tmp_path}/ev"
    _write(spark, p, [(1, 0, 1, "view"), (2, 50, 1, "click")])
    _write(spark, p, [(3, 25, 1, "view"), (1, 0, 1, "view"), (4, 0, 2, "click")])
    t = SessionTable(spark)
    s.feed_sessions(s.read_events(spark, p, spark.read.parquet(p).schema), t, "user_id", "event_id", "ts")
    assert sorted((r.user_id, r.first_impression_id, r.last_impression_id, r.n_impressions) for r in t.read().collect()) == [(1, 1, 2, 3), (2, 4, 4, 1)]


def test_prior_clicks_and_windows(spark, tmp_path):
    p = f"file://{tmp_path}/ev"
    _write(spark, p, [(1, 0, 1, "click"), (2, 1, 1, "view"), (3, 2, 1, "click"), (4, 3, 1, "view"), (5, 90, 2, "view")])
    st = s.read_events(spark, p, spark.read.parquet(p).schema)
    got = s.run_to_table(s.prior_clicks(st.withColumn("is_click", F.col("event_type") == "click")), f"file://{tmp_path}/out")
    assert [r.prior for r in got.where("user_id = 1").orderBy("ts").collect()] == [0, 1, 1, 2]
    st = st.withColumn("ts", F.col("ts").cast("timestamp"))
    w = s.windowed_counts(st, late="0 minutes")
    out = s.run_to_table(w, f"file://{tmp_path}/win")
    assert {(r.event_type, r.n) for r in out.collect()} == {("click", 2), ("view", 2)}


def test_prior_clicks_of_a_long_unsorted_user(spark, tmp_path):
    import random

    rows = [(i, i // 3, 1 + (i % 7 == 0), "click" if i % 2 else "view") for i in range(14_000)]  # three events a minute
    random.Random(3).shuffle(rows)
    p = f"file://{tmp_path}/ev"
    _write(spark, p, rows)
    st = s.read_events(spark, p, spark.read.parquet(p).schema).withColumn("is_click", F.col("event_type") == "click")
    got = sorted((r.user_id, r.ts, r.prior) for r in s.run_to_table(s.prior_clicks(st), f"file://{tmp_path}/out").collect())
    want, n = [], {1: 0, 2: 0}
    for _, m, u, kind in sorted(rows):
        want.append((u, T0 + timedelta(minutes=m), n[u]))
        n[u] += kind == "click"
    assert got == sorted(want)
