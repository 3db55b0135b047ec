"""Histories: the latest clicks with weights, and figures over strictly earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.asof import PERIOD_ROWS, Periods, cut_periods
from newsloom.shared import micros, number

RECENT = 20
DECAY = 0.85


def recent(h: Column, n: int = RECENT) -> Column:
    """The last n entries (all, if fewer)."""
    return F.slice(h, F.greatest(F.size(h) - n + 1, F.lit(1)), F.lit(n))


def recent_weights(inter: DataFrame, n: int = RECENT, decay: float = DECAY, *keep: str) -> DataFrame:
    """``impression_id, article_id, hpos, weight``: the latest n history entries, weight 1 for the newest
    and ``decay`` times as much for each one before. An empty history gives no row."""
    r = inter.select("impression_id", *keep, recent(F.col("history_ids"), n).alias("r"))
    e = r.select("impression_id", *keep, F.size("r").alias("m"), F.posexplode("r").alias("p", "article_id"))
    return e.select("impression_id", *keep, "article_id", (F.col("p") + 1).alias("hpos"), F.pow(F.lit(decay), (F.col("m") - 1 - F.col("p")).cast("double")).alias("weight"))


def _prior(df: DataFrame, key: str, sums: dict[str, Column], cuts: Periods, last: tuple[str, ...] = ()) -> DataFrame:
    """``impression_id`` and, for each name, the sum over the key's rows strictly before in order of
    (time, id); for the columns ``last`` their values in the row just before, as ``last_<column>``. Rows
    are cut into periods of time: totals and last rows of earlier periods are added to what a window
    inside the period gives, so no key's rows ever meet in one task. A NULL key gives no row."""
    d = df.where(F.col(key).isNotNull()).select("impression_id", F.col(key).alias("k"), F.col("t"), cuts.number(F.col("t")).alias("p"), F.struct(F.lit(True).alias("there"), *last).alias("row"), *[c.alias(n) for n, c in sums.items()])
    tot = d.groupBy("k", "p").agg(F.max_by("row", F.struct("t", "impression_id")).alias("end"), *[F.sum(n).alias(n) for n in sums])
    earlier = W.partitionBy("k").orderBy("p")  # at most one row per period
    off = tot.select("k", "p", F.lag("end").over(earlier).alias("__end"), *[F.sum(n).over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias(f"o_{n}") for n in sums])
    w = W.partitionBy("k", "p").orderBy("t", "impression_id")
    run = w.rowsBetween(W.unboundedPreceding, -1)
    j = d.join(off, ["k", "p"]).withColumn("__last", F.coalesce(F.lag("row").over(w), F.col("__end")))
    return j.select("impression_id", *[(F.coalesce(f"o_{n}", F.lit(0)) + F.coalesce(F.sum(n).over(run), F.lit(0))).alias(n) for n in sums], *[F.col(f"__last.{c}").alias(f"last_{c}") for c in last])


def prior_figures(df: DataFrame, legacy_holes: bool = False, spans: int = 64, period_rows: int = PERIOD_ROWS) -> DataFrame:
    """Per impression, over strictly earlier rows: clicks in its session, and the user's mean read time
    and scroll depth. Rows are in order of time (NULL first), then id; a row without session or
    user has 0 clicks or NULL means. NaN counts as no value. ``legacy_holes``: a mean is NULL if the
    row just before has no value.

    ``df``: impression_id (unique), user_id, session_id, impression_time, read_time, scroll_percentage, n_clicked.
    """
    d = df.withColumn("t", micros("impression_time"))
    cuts = cut_periods(d, "t", spans, period_rows)
    rt, sp = number(F.col("read_time")), number(F.col("scroll_percentage"))
    one = lambda c: F.when(c.isNotNull(), 1).otherwise(0)
    s = _prior(d, "session_id", {"clicks": F.col("n_clicked").cast("long")}, cuts)
    u = _prior(d, "user_id", {"rt": F.coalesce(rt, F.lit(0.0)), "rn": one(rt), "sp": F.coalesce(sp, F.lit(0.0)), "sn": one(sp)}, cuts, ("read_time", "scroll_percentage") if legacy_holes else ())
    j = d.select("impression_id").join(s, "impression_id", "left").join(u, "impression_id", "left")
    mean = lambda a, n: F.try_divide(F.col(a), F.col(n).cast("double"))
    holes = lambda m, c: F.when(F.col(f"last_{c}").isNotNull(), m) if legacy_holes else m
    return j.select(
        "impression_id", F.coalesce("clicks", F.lit(0)).cast("long").alias("session_prior_click_count"),
        holes(mean("rt", "rn"), "read_time").alias("user_avg_past_read_time"), holes(mean("sp", "sn"), "scroll_percentage").alias("user_avg_past_scroll_pct"),
    )


def user_slices(inter: DataFrame, threshold: int = 5) -> DataFrame:
    """``impression_id, slice``: cold for histories shorter than the threshold, else warm."""
    return inter.select("impression_id", F.when(F.size("history_ids") < threshold, "cold").otherwise("warm").alias("slice"))
