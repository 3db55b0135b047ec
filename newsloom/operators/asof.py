"""Attributes as they were known at event time.

Method: periodic as-known snapshots plus change logs. Time is cut into periods at quantiles of the
event times, and these evenly into as many more as the number of rows asks for, so the rows of an
entity in a period stay few however many there are in all. A version takes effect once it
is both valid and recorded. For every entity and period in which it has events a snapshot row is
materialised, the best version known when the period began; an event takes the snapshot of its
period and replays only the changes of that period that came before it.

Replay is one ordered pass over the events and changes of an (entity, period), not a join of their
pairs, and a hot entity is spread over all periods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.shared import drop_path, micros, new_path, store


#: rows that a period should hold
PERIOD_ROWS = 1_000_000


@dataclass(frozen=True)
class Periods:
    """Cuts of time: ``edges`` at quantiles, each span between them in ``parts`` of equal length."""

    edges: tuple[int, ...] = ()
    parts: int = 1

    def number(self, t: Column) -> Column:
        """Number of the period of t; it never falls as t rises. A NULL time is in the first."""
        if len(self.edges) < 2:
            return F.lit(0).cast("long")
        edges = F.array(*[F.lit(e).cast("long") for e in self.edges])
        k = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in self.edges[1:-1]]).cast("array<bigint>"), lambda e: e <= t))
        if self.parts == 1:
            return k.cast("long")
        lo, hi = edges[k], edges[k + 1]
        part = F.floor((t - lo) / F.greatest(hi - lo, F.lit(1)) * F.lit(float(self.parts))).cast("long")
        return k * F.lit(self.parts).cast("long") + F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(self.parts - 1)), F.lit(0))


def cut_periods(rows: DataFrame, t: str, spans: int = 64, period_rows: int = PERIOD_ROWS) -> Periods:
    """Periods for the times in column ``t``, from one pass over them."""
    qs = [i / spans for i in range(1, spans)]
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), *([F.percentile_approx(t, qs, 10000).alias("q")] if qs else [])).first()
    if c["lo"] is None:
        return Periods()
    edges = sorted({int(x) for x in (c["lo"], *(c["q"] if qs else []), c["hi"])})
    return Periods(tuple(edges), max(1, -(-c["n"] // (max(1, len(edges) - 1) * period_rows))))


def known_versions(
    events: DataFrame,
    versions: DataFrame,
    event_id: str,
    event_time: str,
    entities: dict[str, str],
    spans: int = 64,
    period_rows: int = PERIOD_ROWS,
    kind: str = "entity_kind",
    entity: str = "entity_id",
    valid_from: str = "valid_from",
    recorded_at: str = "recorded_at",
    version: str = "version_id",
) -> DataFrame:
    """``event_id, entity_kind, version_id``: for each event and each of its entities the version
    with ``valid_from`` and ``recorded_at`` both strictly before the event; of several the latest
    valid_from, then recorded_at, then the greatest version.

    ``entities`` maps a kind to the event column that holds the entity. Events without id or time
    and NULL entities give no row, nor do entities without a known version. Repeated events count
    once, repeated versions change nothing; versions without valid_from or recorded_at never became
    known. An event id seen with several times or entities gives a row for each kind at its first
    time. Other columns are ignored.
    """
    spark = events.sparkSession
    paths: list[str] = []

    def keep(d: DataFrame, name: str) -> DataFrame:
        paths.append(new_path(spark, name))
        return store(d, paths[-1])

    ev = events.select(F.col(event_id).alias("e"), micros(event_time).alias("t"), *[F.col(c).cast("string").alias(f"k_{i}") for i, c in enumerate(entities.values())]).where("e IS NOT NULL AND t IS NOT NULL")
    cuts = cut_periods(ev, "t", spans, period_rows)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{i}").alias("id")) for i, k in enumerate(entities)])
    ev = ev.select("e", "t", F.explode(kinds).alias("x")).select("e", "t", "x.kind", "x.id").where("id IS NOT NULL")
    # Repeats merge before the shuffle.
    ev = keep(ev.groupBy("e", "kind").agg(F.min("t").alias("t"), F.min_by("id", F.struct("t", "id")).alias("id")).withColumn("period", cuts.number(F.col("t"))), "p5-events")

    change = F.struct(micros(valid_from).alias("vf"), micros(recorded_at).alias("ra"), F.col(version).cast("long").alias("ver"))
    log = versions.where(F.col(kind).isin(*entities)).select(F.col(kind).alias("kind"), F.col(entity).cast("string").alias("id"), change.alias("c")).where("id IS NOT NULL AND c.vf IS NOT NULL AND c.ra IS NOT NULL AND c.ver IS NOT NULL")
    log = log.withColumn("t", F.greatest("c.vf", "c.ra")).withColumn("period", cuts.number(F.col("t")))

    # Snapshots: the running best of the periods before, for the periods that have events. An
    # entity has at most two rows per period here.
    best = log.groupBy("kind", "id", "period").agg(F.max("c").alias("c")).withColumn("asked", F.lit(False))
    asked = ev.select("kind", "id", "period").distinct().select("kind", "id", "period", F.lit(None).cast(best.schema["c"].dataType).alias("c"), F.lit(True).alias("asked"))
    before = W.partitionBy("kind", "id").orderBy("period").rangeBetween(W.unboundedPreceding, -1)
    snap = best.unionByName(asked).withColumn("known", F.max("c").over(before)).where("asked AND known IS NOT NULL")
    snap = keep(snap.select("kind", "id", "period", F.col("known").alias("c")), "p5-snapshots")

    # Replay: snapshot first, then events and changes in order of time; at equal times the event
    # comes first, for only what was known strictly before it counts.
    none = F.lit(None).cast(best.schema["c"].dataType)
    lowest = F.lit(-(2**63)).cast("long")
    touched = log.join(asked.select("kind", "id", "period"), ["kind", "id", "period"], "left_semi")
    lines = (
        ev.select("kind", "id", "period", "t", F.lit(0).alias("o"), "e", none.alias("c"))
        .unionByName(touched.select("kind", "id", "period", "t", F.lit(1).alias("o"), F.lit(None).cast(ev.schema["e"].dataType).alias("e"), "c"))
        .unionByName(snap.select("kind", "id", "period", lowest.alias("t"), F.lit(1).alias("o"), F.lit(None).cast(ev.schema["e"].dataType).alias("e"), "c"))
    )
    w = W.partitionBy("kind", "id", "period").orderBy("t", "o").rowsBetween(W.unboundedPreceding, 0)
    out = lines.withColumn("k", F.max("c").over(w)).where("e IS NOT NULL AND k IS NOT NULL")
    return out.select(F.col("e").alias(event_id), F.col("kind").alias("entity_kind"), F.col("k.ver").alias("version_id"))


def known_attributes(events: DataFrame, versions: DataFrame, event_id: str, event_time: str, entities: dict[str, str], values: dict[str, str], spans: int = 64, period_rows: int = PERIOD_ROWS) -> DataFrame:
    """One row per event that has a known version: ``event_id`` and the value column of each kind.
    ``values`` maps a kind to its column in ``versions``. A known version with a NULL value gives
    NULL, as does an entity without a known version. Of versions sharing an id the greatest value
    counts."""
    k = known_versions(events, versions, event_id, event_time, entities, spans, period_rows)
    pick = F.coalesce(*[F.when(F.col("entity_kind") == kd, F.col(c).cast("double")) for kd, c in values.items()])
    v = versions.select("entity_kind", "version_id", pick.alias("val")).groupBy("entity_kind", "version_id").agg(F.max("val").alias("val"))
    j = k.join(v, ["entity_kind", "version_id"])
    return j.groupBy(event_id).agg(*[F.max(F.when(F.col("entity_kind") == kd, F.col("val"))).alias(c) for kd, c in values.items()])
