"""Sessions separated by idle gaps, kept in an incremental table.

Method: each batch is cut into local sessions; they are compared with the stored sessions within
the gap, bridged components are merged, and the affected part of the table is replaced atomically.

The table is cut by time (parts of some days, by session start) and by user (buckets). The manifest
names the file of every part and bucket with its bounds in time. A batch reads and rewrites only
those its own users and times can reach. A manifest is published under the next version number in
one rename that fails if another writer was first; then the batch is applied again to what that one
published. Files that neither the published manifest nor the one before it names are removed.

Events less than a gap apart in one gap-wide cell of time always share a session, so events are
first merged per (user, cell) with partial aggregation. A user has at most one row per cell,
however many events, and no window ever runs over raw events.

Repeated events are known by their id: the table also keeps the ids it has counted, by part of time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.shared import create_once, drop_path, hadoop_path, materialize, may_match, micros, new_path, read_text

GAP = 30 * 60 * 1_000_000
DAY = 86_400_000_000
SESSION_SCHEMA = "user_id long, start long, first_id long, end long, last_id long, n long"
EVENT_SCHEMA = "user_id long, id long, t long, bucket int, part long"
ID_SCHEMA = "id long"
#: files of ids of a part beyond which they are put together
MANY_FILES = 16


def _merge(pieces: DataFrame, gap: int) -> DataFrame:
    """Merge overlapping or bridged pieces (user_id, a=(start, first_id), z=(end, last_id), n). A user
    has at most one piece per gap-wide cell and source."""
    w = W.partitionBy("user_id").orderBy("a", "z")
    reach = F.max("z.t").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = pieces.withColumn("new", F.when(F.col("a.t") - reach <= gap, 0).otherwise(1))
    run = cut.withColumn("s", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("user_id", "s").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n")).drop("s")


def _cells(events: DataFrame, gap: int) -> DataFrame:
    x = F.struct("t", "id")
    return events.groupBy("user_id", F.floor(F.col("t") / gap).alias("cell")).agg(F.min(x).alias("a"), F.max(x).alias("z"), F.count(F.lit(1)).alias("n")).drop("cell")


class SessionTable:
    """A session table in a shared folder: parts span ``part_days`` days by session start, users are
    dealt to ``buckets``. ``same_time``: copies of an event carry its time, so a copy can only match ids of
    its own part; if copies may come with other times, False compares with the ids of all parts."""

    def __init__(self, spark: SparkSession, path: str | None = None, gap_us: int = GAP, part_days: int = 7, buckets: int = 8, same_time: bool = True):
        self.spark, self.gap, self.width, self.buckets, self.same_time = spark, gap_us, part_days * DAY, buckets, same_time
        self.path = path or new_path(spark, "sessions")

    # -- manifest --
    def _name(self, version: int) -> str:
        return f"{self.path}/manifest-{version:012}.json"

    def _version(self) -> int:
        """The last version published, 0 if none."""
        p, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        """``sessions``: part to bucket to path and bounds; ``ids``: part to paths."""
        text = read_text(self.spark, self._name(self._version() if version is None else version))
        return json.loads(text) if text else {"version": 0, "sessions": {}, "ids": {}}

    @staticmethod
    def _paths(m: dict) -> set[str]:
        return {s["path"] for bs in m["sessions"].values() for s in bs.values()} | {p for ps in m["ids"].values() for p in ps}

    def _publish(self, m: dict) -> bool:
        v = m["version"]
        if not create_once(self.spark, self._name(v), json.dumps(m).encode()):
            return False
        if v > 2:
            kept = self._paths(m) | self._paths(self._manifest(v - 1))
            for path in self._paths(self._manifest(v - 2)) - kept:
                drop_path(self.spark, path)
            drop_path(self.spark, self._name(v - 2))
        return True

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _part(self, t: Column) -> Column:
        return F.floor(t / F.lit(self.width)).cast("long")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    # -- writing --
    def apply(self, batch: DataFrame, user: str, event_id: str, time: str) -> dict:
        """Add a batch of events. Rows without user, id or time don't count. An id counts once: within
        a batch at its earliest time, and a copy of an id counted before changes nothing. Gives the paths
        of the stored files that were ``read`` and the parts and buckets ``written``."""
        ev = batch.select(F.col(user).cast("long").alias("user_id"), F.col(event_id).cast("long").alias("id"), micros(time).alias("t")).where("user_id IS NOT NULL AND id IS NOT NULL AND t IS NOT NULL")
        ev = ev.groupBy("id").agg(F.min("t").alias("t"), F.min_by("user_id", F.struct("t", "user_id")).alias("user_id"))
        ev = materialize(ev.withColumn("part", self._part(F.col("t"))).withColumn("bucket", self._bucket()), "batch")
        while (done := self._apply(ev)) is None:
            pass  # another writer published first
        return done

    def _apply(self, ev: DataFrame) -> dict | None:
        m = self._manifest()
        v = m["version"] + 1
        root = f"{self.path}/v{v}-{uuid.uuid4().hex[:12]}"
        own = sorted(str(r[0]) for r in ev.select("part").distinct().collect())  # one row a part
        known = {p: m["ids"].get(p, []) for p in (own if self.same_time else m["ids"])}
        old_ids = [x for ps in known.values() for x in ps]
        fresh = ev
        if old_ids:
            stored_ids = may_match(self._read(old_ids, ID_SCHEMA), ev, ["id"])
            fresh = ev.join(stored_ids, "id", "left_anti")
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{root}/events")
        fresh = self.spark.read.schema(EVENT_SCHEMA).parquet(f"{root}/events")
        spans = fresh.groupBy("part", "bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()  # one row a part and bucket
        if not spans:
            drop_path(self.spark, root)
            return {"read": [], "written": []}
        reach: dict[str, list[tuple[int, int, str]]] = {}
        for s in spans:
            reach.setdefault(str(s["bucket"]), []).append((s["lo"] - self.gap, s["hi"] + self.gap, str(s["part"])))
        hit = [(p, b) for p, bs in m["sessions"].items() for b, s in bs.items() if any(x == p or lo <= s["max"] and hi >= s["min"] for lo, hi, x in reach.get(b, ()))]
        read = [m["sessions"][p].pop(b)["path"] for p, b in hit]
        stored = self._read(read, SESSION_SCHEMA)
        kept = stored.select("user_id", F.struct(F.col("start").alias("t"), F.col("first_id").alias("id")).alias("a"), F.struct(F.col("end").alias("t"), F.col("last_id").alias("id")).alias("z"), "n")
        merged = _merge(_merge(_cells(fresh, self.gap), self.gap).unionByName(kept), self.gap)
        out = merged.select("user_id", F.col("a.t").alias("start"), F.col("a.id").alias("first_id"), F.col("z.t").alias("end"), F.col("z.id").alias("last_id"), "n")
        out = out.withColumn("part", self._part(F.col("start"))).withColumn("bucket", self._bucket())
        path = f"{root}/sessions"
        out.repartition("part", "bucket").write.mode("overwrite").partitionBy("part", "bucket").parquet(path)
        written = self.spark.read.parquet(path).groupBy("part", "bucket").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).collect()
        for r in written:
            m["sessions"].setdefault(str(r["part"]), {})[str(r["bucket"])] = {"path": f"{path}/part={r['part']}/bucket={r['bucket']}", "min": r["lo"], "max": r["hi"]}
        for p in {str(s["part"]) for s in spans}:
            m["ids"][p] = [*m["ids"].get(p, []), f"{root}/events/part={p}"]
            if len(m["ids"][p]) > MANY_FILES:
                self._read(m["ids"][p], ID_SCHEMA).write.mode("overwrite").parquet(f"{root}/ids/part={p}")
                m["ids"][p] = [f"{root}/ids/part={p}"]
        m["version"] = v
        if not self._publish(m):
            drop_path(self.spark, root)
            return None
        return {"read": read, "written": sorted((r["part"], r["bucket"]) for r in written)}

    # -- reading --
    def read(self) -> DataFrame:
        """``user_id, session_start, session_end`` (microseconds), ``duration_s, n_impressions,
        first_impression_id, last_impression_id``. Good until two more batches are published."""
        m = self._manifest()
        d = self._read([s["path"] for bs in m["sessions"].values() for s in bs.values()], SESSION_SCHEMA)
        return d.select(
            "user_id", F.col("start").alias("session_start"), F.col("end").alias("session_end"), ((F.col("end") - F.col("start")) / 1e6).alias("duration_s"),
            F.col("n").alias("n_impressions"), F.col("first_id").alias("first_impression_id"), F.col("last_id").alias("last_impression_id"),
        )


def sessions_from_log(log: DataFrame, user: str, event_id: str, time: str, arrival: str, batches: int = 4, gap_us: int = GAP) -> DataFrame:
    """Feed a log to a fresh table in batches of arrival time and read the sessions. An empty log
    gives no rows; rows without arrival time come in the last batch."""
    spark = log.sparkSession
    a = log.select("*", micros(arrival).alias("__a")) if "__a" not in log.columns else log
    a = a.select(F.col(user).alias("u"), F.col(event_id).alias("i"), F.col(time).alias("t"), F.coalesce(F.col("__a"), F.lit(2**63 - 1)).alias("arr"))
    cuts = a.where(F.col("arr") < 2**63 - 1).agg(F.percentile_approx("arr", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = [-(2**63), *sorted({int(c) for c in cuts or []}), 2**63 - 1]
    tbl = SessionTable(spark, gap_us=gap_us)
    for lo, hi in zip(edges, edges[1:]):
        upper = F.col("arr") < hi if hi < 2**63 - 1 else F.lit(True)
        tbl.apply(a.where((F.col("arr") >= lo) & upper), "u", "i", "t")
    return tbl.read()
