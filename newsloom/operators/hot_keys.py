"""Per-key counts and exact quantiles when a few keys hold most records.

Method: distributed exact selection. Level 0 counts every key's values in bins of a fixed logarithmic
scale. Each wanted rank falls into one bin; a bin whose least or greatest value has that rank resolves
it, every other bin is cut into finer bins and counted again, until all ranks resolve. The bins of every
level follow from the value alone, so a row needs no join to find its bin: counts and bounds merge in
the tasks that read the rows, and only those partial counts are shuffled, never a value of a hot key
as often as it occurs.

A level reads only rows of unresolved bins. They are sifted before the shuffle: by a broadcast of the
open bins while these are few, else by a bitmap of fixed size; the exact join follows on the counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.shared import BROADCAST_ROWS, drop_path, may_match, new_path, number, store

PER_OCTAVE = 16
#: bits by which a bin is cut at each level, and the level whose bins hold single values
LEVEL_BITS, LAST_LEVEL = 12, 4
#: bins of at most so many rows are counted by value at once
FEW_ROWS = 4096


def _log_bin(v: Column) -> Column:
    """An integer that never falls as the value rises; 16 bins to the doubling."""
    mag = F.floor(F.log(F.abs(v)) * F.lit(PER_OCTAVE / math.log(2.0))).cast("int") + F.lit(40000)
    return F.when(v.isNull(), F.lit(None).cast("int")).when(v == 0, F.lit(0)).when(v > 0, mag).otherwise(-mag)


def _place(v: Column, b: Column) -> Column:
    """The place of a value's magnitude within its bin, from 0 to below 1: it never falls as the
    magnitude rises."""
    low = F.pow(F.lit(2.0), (F.abs(b) - 40000) / F.lit(float(PER_OCTAVE)))
    y = (F.abs(v) / low - 1.0) / F.lit(2.0 ** (1.0 / PER_OCTAVE) - 1.0)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0 - 2.0**-52)))


def _finer(level: int) -> Column:
    """Number of the bin at a level: scaling by a power of two is exact, so levels nest."""
    return F.floor(F.col("y") * F.lit(2.0 ** (LEVEL_BITS * level))).cast("long")


def key_quantiles(
    df: DataFrame,
    key: str,
    value: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    min_share: float | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    few_rows: int = FEW_ROWS,
) -> DataFrame:
    """One row per key: ``key_value`` (the key as string), ``n_rows``, ``n_values``, ``total_rows`` and ``quantiles``.

    ``n_rows`` counts rows as stored, repeats included. A quantile p is the value of rank
    ceil(p * n_values), at least 1: always a value that occurs. NULL and NaN are no values; a key
    without values has NULL quantiles. A NULL key is no key, though its rows count in
    ``total_rows``. Infinities count as the largest finite double of their sign. ``min_share``
    keeps the keys with at least that share of all rows, at most 1 / min_share of them; they are
    counted first, and no other key's values are looked at. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    big = F.lit(1.7976931348623157e308)
    raw = number(F.col(value))
    v = F.when(raw.isNotNull(), F.greatest(F.least(raw, big), -big))
    rows = df.select(F.col(key).cast("string").alias("k"), v.alias("v"))
    paths: list[str] = []

    def keep(d: DataFrame, name: str) -> DataFrame:
        paths.append(new_path(spark, name))
        return store(d, paths[-1])

    if min_share is not None:
        sizes = keep(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")), "p2-sizes")
        total = sizes.agg(F.sum("n_rows")).first()[0] or 0
        wanted = keep(sizes.where(F.col("k").isNotNull() & (F.col("n_rows") >= F.lit(min_share * total * (1 - 1e-12)))).select("k"), "p2-wanted")
        few = min_share > 0 and 1 / min_share <= broadcast_rows
        rows = rows.join(F.broadcast(wanted) if few else wanted, "k", "left_semi")
    rows = rows.withColumn("b", _log_bin(F.col("v"))).withColumn("y", _place(F.col("v"), F.col("b")))

    # Level 0: mergeable counts and bounds per (key, bin).
    bounds = [F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    hist = keep(rows.groupBy("k", "b").agg(*bounds), "p2-hist")
    if min_share is None:
        total = hist.agg(F.sum("c")).first()[0] or 0
    hist = hist.where("k IS NOT NULL")
    counts = keep(hist.groupBy("k").agg(F.sum("c").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.col("c"))), F.lit(0)).alias("n_values")), "p2-counts")

    # One target rank per key and probability.
    ps = F.array(*[F.lit(float(p)) for p in probs]) if probs else F.array().cast("array<double>")
    targets = counts.where("n_values > 0").select("k", "n_values", F.posexplode(ps).alias("pi", "p")).select("k", "pi", F.greatest(F.ceil(F.col("p") * F.col("n_values")), F.lit(1)).cast("long").alias("rank"))

    def locate(bins: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
        """The bin that holds each wanted rank, with the rank inside that bin. What is cut into these
        bins has a bounded number of them, so the running sum is bounded."""
        w = W.partitionBy(*keys).orderBy("lo").rowsBetween(W.unboundedPreceding, 0)
        run = bins.withColumn("upto", F.sum("c").over(w))
        return ranks.join(run, keys).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))).withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c"))).drop("upto")

    def settled(found: DataFrame) -> DataFrame:
        """Ranks that are a bound of their bin."""
        q = F.when((F.col("rank") == 1) | (F.col("lo") == F.col("hi")), F.col("lo")).when(F.col("rank") == F.col("c"), F.col("hi"))
        return found.withColumn("q", q)

    found = keep(settled(locate(hist.where("b IS NOT NULL"), targets, ["k"]).withColumn("p", F.lit(0).cast("long"))), "p2-found")
    done = [found.where("q IS NOT NULL").select("k", "pi", "q")]
    open_ = found.where("q IS NULL")
    level = 0
    bin_ = ["k", "b", "p"]
    while (n_open := open_.select(*bin_).distinct().count()) > 0:
        # Each open bin once, whatever number of ranks fall into it; it is cut by level or by value.
        last = level >= LAST_LEVEL
        bins = keep(open_.select(*bin_, (F.lit(last) | (F.col("c") <= few_rows)).alias("by_value")).distinct(), f"p2-open{level}")
        read = rows.where("k IS NOT NULL AND b IS NOT NULL").withColumn("p", _finer(level))
        cut = _finer(level + 1)
        if n_open <= broadcast_rows:
            part = read.join(F.broadcast(bins), bin_).select(*bin_, "by_value", "v", F.when(~F.col("by_value"), cut).alias("sub"))
        else:
            # A row may be sifted into both ways of cutting; the join below drops what no open bin asked for.
            ways = [may_match(read, bins.where(F.col("by_value") == x), bin_).select(*bin_, F.lit(x).alias("by_value"), "v", (F.lit(None).cast("long") if x else cut).alias("sub")) for x in (True, False)]
            part = ways[0].unionByName(ways[1])
        each = part.withColumn("at", F.when(F.col("by_value"), F.col("v"))).groupBy(*bin_, "by_value", "sub", "at").agg(*bounds)
        if n_open > broadcast_rows:
            each = each.join(bins, [*bin_, "by_value"], "left_semi")
        nxt = locate(each.drop("at", "by_value"), open_.select(*bin_, "pi", "rank"), bin_)
        found = keep(settled(nxt.select("k", "b", F.col("sub").alias("p"), "pi", "rank", "c", "lo", "hi")), f"p2-found{level + 1}")
        done.append(found.where("q IS NOT NULL").select("k", "pi", "q"))
        open_ = found.where("q IS NULL")
        level += 1
    qs = done[0]
    for d in done[1:]:
        qs = qs.unionByName(d)
    # At most one entry per probability meets in a key.
    qs = qs.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pi", "q"))), lambda x: x["q"]).alias("quantiles"))
    out = keep(
        counts.join(qs, "k", "left").select(F.col("k").alias("key_value"), "n_rows", "n_values", F.lit(total).cast("long").alias("total_rows"), "quantiles"),
        "p2-out",
    )
    for p in paths[:-1]:
        drop_path(spark, p)
    return out
