"""As-known attributes and sessions, against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import sessions
from newsloom.operators.asof import cut_periods, known_attributes, known_versions
from newsloom.operators.sessions import SessionTable, sessions_from_log
from newsloom.shared import hadoop_path

T0 = datetime(2031, 1, 1)
EV = "impression_id long, impression_time timestamp_ntz, user_id long, article_id string, version_id int"
VE = "version_id long, entity_kind string, entity_id string, user_avg_past_read_time double, article_train_ctr double, valid_from timestamp_ntz, recorded_at timestamp_ntz"


def _data(seed, n=300):
    r = random.Random(seed)
    t = lambda: None if r.random() < 0.05 else T0 + timedelta(minutes=r.randrange(60))
    ev = [(i, t(), r.choice([1, 1, 1, 2, None]), r.choice(["a", "b", None]), 0) for i in range(n)]
    ev += ev[:20]
    ve = []
    for i in range(n):
        k = r.choice(["user", "article", "other"])
        ve.append((i, k, r.choice(["1", "2", "3"]) if k == "user" else r.choice(["a", "b", "c", None]), r.choice([None, 1.0, 2.5]), r.choice([None, 0.5]), t(), t()))
    return ev, ve + ve[:20]


def test_known_versions(spark):
    for seed, spans, each in ((1, 8, 1000), (2, 1, 1000), (3, 64, 1000), (1, 4, 5), (2, 1, 1)):
        ev, ve = _data(seed)
        e, v = spark.createDataFrame(ev, EV), spark.createDataFrame(ve, VE)
        got = sorted((r.impression_id, r.entity_kind, r.version_id) for r in known_versions(e, v, "impression_id", "impression_time", {"user": "user_id", "article": "article_id"}, spans, each).collect())
        want = set()
        for i, t, u, a, _ in ev:
            for kind, x in (("user", None if u is None else str(u)), ("article", a)):
                c = [(vf, ra, ver) for ver, k, y, _, _, vf, ra in ve if k == kind and y == x and x is not None and vf and ra and t and vf < t and ra < t]
                if c:
                    want.add((i, kind, max(c)[2]))
        assert got == sorted(want)


def test_known_attributes_and_empty(spark):
    ev, ve = _data(5, 60)
    e, v = spark.createDataFrame(ev, EV), spark.createDataFrame(ve, VE)
    ent, val = {"user": "user_id", "article": "article_id"}, {"user": "user_avg_past_read_time", "article": "article_train_ctr"}
    k = known_versions(e, v, "impression_id", "impression_time", ent)
    assert known_attributes(e, v, "impression_id", "impression_time", ent, val).count() == k.select("impression_id").distinct().count()
    assert known_versions(e.limit(0), v, "impression_id", "impression_time", ent).count() == 0
    assert known_versions(e, v.limit(0), "impression_id", "impression_time", ent).count() == 0


def _brute(rows):
    seen, by = {}, {}
    for u, i, t, _ in rows:
        if u is not None and t is not None and i is not None:
            seen.setdefault(i, (u, t))
    for i, (u, t) in seen.items():
        by.setdefault(u, []).append((t, i))
    out = []
    for u, xs in by.items():
        xs.sort()
        cur = [xs[0]]
        for x in xs[1:]:
            if x[0] - cur[-1][0] > timedelta(minutes=30):
                out.append((u, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(x)
        out.append((u, cur[0][1], cur[-1][1], len(cur)))
    return sorted(out)


SC = "user_id long, impression_id long, impression_time timestamp_ntz, ingested_time timestamp_ntz"


def _log(seed, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = None if r.random() < 0.03 else T0 + timedelta(minutes=r.choice([r.randrange(3000), r.randrange(0, 40_000, 30), r.randrange(200)]))
        late = timedelta(minutes=r.choice([1, 5, 3000]))
        rows.append((r.choice([1, 1, 1, 2, 3, None]), i, t, None if r.random() < 0.03 else (t or T0) + late))
    again = [(u, i, t, a and a + timedelta(days=1)) for u, i, t, a in rows[:60]]
    return rows + again


def _seen(d):
    return sorted((r.user_id, r.first_impression_id, r.last_impression_id, r.n_impressions) for r in d.collect())


def test_sessions_by_batches(spark):
    for seed, batches in ((1, 4), (2, 1)):
        rows = _log(seed)
        d = spark.createDataFrame(rows, SC).withColumn("n", F.lit(0)).withColumn("start", F.lit("x"))
        assert _seen(sessions_from_log(d, "user_id", "impression_id", "impression_time", "ingested_time", batches)) == _brute(rows)


def test_bridge_repeat_and_empty_batches(spark):
    t = SessionTable(spark)
    mk = lambda xs: spark.createDataFrame([(u, i, T0 + timedelta(minutes=m), None) for u, i, m in xs], SC)
    cols = ("user_id", "impression_id", "impression_time")
    t.apply(mk([]), *cols)
    assert t.read().count() == 0
    t.apply(mk([(1, 1, 0), (1, 2, 60)]), *cols)
    assert _seen(t.read()) == [(1, 1, 1, 1), (1, 2, 2, 1)]
    t.apply(mk([(1, 3, 30), (1, 1, 0), (2, 9, 5)]), *cols)  # bridges both sessions, and repeats one
    assert _seen(t.read()) == [(1, 1, 2, 3), (2, 9, 9, 1)]
    t.apply(mk([(1, 1, 0)]), *cols)
    assert _seen(t.read()) == [(1, 1, 2, 3), (2, 9, 9, 1)]
    assert t.read().where("user_id = 1").first().duration_s == 3600.0


def test_batches_of_one_week_far_apart(spark):
    t = SessionTable(spark)
    cols = ("user_id", "impression_id", "impression_time")
    for xs in ([(1, 1, 0), (1, 2, 10)], [(1, 3, 600), (2, 4, 610)], [(1, 5, 300)]):  # the last falls between stored sessions
        t.apply(spark.createDataFrame([(u, i, T0 + timedelta(minutes=m), None) for u, i, m in xs], SC), *cols)
    assert _seen(t.read()) == [(1, 1, 2, 2), (1, 3, 3, 1), (1, 5, 5, 1), (2, 4, 4, 1)]


def _batch(spark, xs):
    return spark.createDataFrame([(u, i, T0 + timedelta(minutes=m), None) for u, i, m in xs], SC)


COLS = ("user_id", "impression_id", "impression_time")


def test_a_batch_reads_only_what_it_can_reach(spark):
    week = 7 * 24 * 60
    t = SessionTable(spark, buckets=4)
    t.apply(_batch(spark, [(u, 100 * w + u, w * week + u) for w in range(12) for u in range(20)]), *COLS)
    files = {s["path"] for bs in t._manifest()["sessions"].values() for s in bs.values()}
    did = t.apply(_batch(spark, [(3, 9001, 5 * week + 10), (3, 503, 5 * week + 3)]), *COLS)
    assert len(files) > 40 and len(did["read"]) == len(did["written"]) == 1
    assert (files - {s["path"] for bs in t._manifest()["sessions"].values() for s in bs.values()}) == set(did["read"])
    got = t.read().where("user_id = 3").orderBy("session_start").collect()
    assert len(got) == 12 and [r.n_impressions for r in got] == [1] * 5 + [2] + [1] * 6


def test_two_writers_lose_nothing(spark):
    t = SessionTable(spark)
    t.apply(_batch(spark, [(1, 1, 0)]), *COLS)
    publish, other = t._publish, SessionTable(spark, t.path)

    def late(m):
        t._publish = publish
        other.apply(_batch(spark, [(1, 2, 20), (2, 3, 5)]), *COLS)
        return publish(m)

    t._publish = late
    t.apply(_batch(spark, [(1, 4, 40)]), *COLS)
    assert _seen(t.read()) == [(1, 1, 4, 3), (2, 3, 3, 1)] and t._version() == 3


def test_old_files_go_and_files_of_ids_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(sessions, "MANY_FILES", 2)
    t = SessionTable(spark)
    for k in range(6):
        t.apply(_batch(spark, [(1, k, k), (1, max(k - 1, 0), max(k - 1, 0))]), *COLS)
    assert _seen(t.read()) == [(1, 0, 5, 6)]
    p, fs = hadoop_path(spark, t.path)
    names = [f.getPath().toString() for f in fs.listStatus(p)]
    assert sum("manifest-" in n for n in names) == 2
    files = set()
    it = fs.listFiles(p, True)
    while it.hasNext():
        files.add(it.next().getPath().toString())
    kept = t._paths(t._manifest()) | t._paths(t._manifest(5))
    assert sum("/sessions/" in f and f.endswith(".parquet") for f in files) == 2 and len(kept) < 8


def test_copies_with_other_times(spark):
    week = 7 * 24 * 60
    for same_time, n in ((True, 2), (False, 1)):
        t = SessionTable(spark, same_time=same_time)
        t.apply(_batch(spark, [(1, 1, 0)]), *COLS)
        t.apply(_batch(spark, [(1, 1, 2 * week)]), *COLS)
        assert t.read().count() == n


def test_periods_never_fall(spark):
    r = random.Random(4)
    ts = sorted(r.choice([r.randrange(1000), r.randrange(10**9), 500]) for _ in range(400))
    d = spark.createDataFrame([(t,) for t in ts] + [(None,)], "t long")
    for spans, each in ((1, 1000), (1, 7), (8, 1000), (8, 5), (64, 1)):
        cuts = cut_periods(d, "t", spans, each)
        got = [(x.t, x.p) for x in d.select("t", cuts.number(F.col("t")).alias("p")).collect()]
        ps = [p for _, p in sorted((t, p) for t, p in got if t is not None)]
        assert ps == sorted(ps) and dict(got)[None] == 0 and ps[-1] <= (len(cuts.edges) - 1) * cuts.parts
        outside = spark.createDataFrame([(-5,), (10**12,)], "t long").select(cuts.number(F.col("t")).alias("p")).collect()
        assert outside[0].p == ps[0] and outside[1].p >= ps[-1]
    assert cut_periods(d.limit(0), "t").edges == ()
