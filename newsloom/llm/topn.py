"""Top N items within every group.

Method: descending score bands. The scored items are stored in bands cut at quantiles of the score.
Bands are processed from the top: rows of groups already filled are removed by an anti-join before
anything is ranked, the others are ranked by the exact tie rule, and a group takes from the band only
what it still needs, so the band in which it fills up is its last.

The anti-join is a broadcast while few groups are filled or few are open; beyond that a bitmap of
fixed size sifts the rows before the shuffle, and what it lets through by chance takes nothing.
Ranking keeps at most N rows per group and task before the shuffle (window group limit), so a group
of any size sends at most N rows from each task. State is one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.shared import BROADCAST_ROWS, drop_path, first_rows, materialize, may_match, new_path, number, store


def latest_scores(df: DataFrame, group: str, item: str, values: dict[str, str], version: str | None, position: str | None) -> DataFrame:
    """One row per (g, i): the values of the latest version, NaN as NULL. Of several rows with the
    latest version the one with the highest values in order counts, then the lowest position. Rows
    without group or item name nothing and drop out; a NULL version is older than any other."""
    v = F.col(version) if version else F.lit(0)
    p = F.col(position).cast("long") if position else F.lit(None).cast("long")
    src = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[number(F.col(c)).alias(a) for a, c in values.items()], p.alias("p"), v.alias("v")).where("g IS NOT NULL AND i IS NOT NULL")
    order = [F.col("v").desc_nulls_last(), *[F.col(a).desc_nulls_last() for a in values], F.col("p").asc_nulls_last()]
    return first_rows(src, ["g", "i"], order).drop("v")


def top_n(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int = 5,
    position: str | None = None,
    version: str | None = None,
    bands: Sequence[float] = (0.5, 0.75, 0.875),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``group, item, score, rank``: the n items of each group with the highest score.

    Equal scores: the lower position goes first (NULL last), then the lesser item. NULL and NaN
    scores never count; a group without scores gives no row, a small one all it has. With
    ``version`` only the latest row of an item counts, whether scored or not. ``bands`` are the
    quantiles of the score at which bands are cut. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    cuts = df.select(number(F.col(score)).alias("s")).agg(F.percentile_approx("s", sorted(bands, reverse=True), 1000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts}, reverse=True)
    band: Column = F.lit(len(cuts))
    for b in range(len(cuts) - 1, -1, -1):
        band = F.when(F.col("s") >= cuts[b], b).otherwise(band)
    scored = latest_scores(df, group, item, {"s": score}, version, position).where("s IS NOT NULL").withColumn("band", band)
    path = new_path(spark, "p1-bands")
    rows = store(scored, path, "band")
    outs: list[DataFrame] = []
    for b in range(len(cuts) + 1):
        best = rank_band(rows.where(F.col("band") == b).drop("band"), outs, rows, n, broadcast_rows)
        outs.append(store(best, new_path(spark, f"p1-band{b}")))
    drop_path(spark, path)
    return _union(outs).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))


def rank_band(band: DataFrame, outs: list[DataFrame], rows: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """``g, i, s, r`` that a band (g, i, s, p) adds to what the bands above gave."""
    best = W.partitionBy("g").orderBy(F.col("s").desc(), F.col("p").asc_nulls_last(), F.col("i"))
    taken = None
    if outs:
        taken = _union(outs).groupBy("g").agg(F.count(F.lit(1)).alias("taken"))
        band = unfilled(band, taken, rows, n, broadcast_rows)
    out = band.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n)
    if taken is not None:
        out = out.join(taken, "g", "left").withColumn("r", F.col("r") + F.coalesce("taken", F.lit(0))).where(F.col("r") <= n)
    return out.select("g", "i", "s", F.col("r").cast("int").alias("r"))


def unfilled(band: DataFrame, taken: DataFrame, rows: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """The band without the rows of groups that have n items."""
    filled = taken.where(F.col("taken") >= n).select("g")
    if filled.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return band.join(F.broadcast(filled), "g", "left_anti")
    still = materialize(rows.select("g").distinct().join(filled, "g", "left_anti"), "p1-open")
    if still.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return band.join(F.broadcast(still), "g", "left_semi")
    return may_match(band, still, ["g"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
