"""One ranking from several differently-scaled scores.

Method: reciprocal rank fusion. Items are ranked separately by each score within their group, the
inverses of rank plus a constant are summed, and the total orders the group.

The rank of an item is the number of items of its group with a score at least as high: tied items
share their worst rank, and rank 1 means strictly the highest. An item without a score gets no
rank and nothing from that score.

Groups of more than ``group_rows`` rows, a fixed number that one task can sort, are ranked apart.
Their rows are sorted by range, ties parted by item, and places follow from the place in the partition
and the sizes of the partitions before. A value's rank is its last place; values are joined back to
the rows, those of many rows by broadcast, rows without a value beside the join. No task holds a
whole group, or all rows of one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.topn import latest_scores
from newsloom.shared import BROADCAST_ROWS, join_keys, materialize

GROUP_ROWS = 100_000


def _order() -> list:
    return [F.col("rrf").desc(), F.col("p").asc_nulls_last(), F.col("i")]


def _fuse(d: DataFrame, n: int, k: int) -> DataFrame:
    total = sum((F.coalesce(1.0 / (F.col(f"r{j}") + F.lit(k)), F.lit(0.0)) for j in range(n)), F.lit(0.0))
    return d.withColumn("rrf", F.round(total, 12))


def _small_groups(d: DataFrame, n: int, k: int) -> DataFrame:
    for j in range(n):
        w = W.partitionBy("g").orderBy(F.col(f"s{j}").desc_nulls_last()).rangeBetween(W.unboundedPreceding, 0)
        d = d.withColumn(f"r{j}", F.when(F.col(f"s{j}").isNotNull(), F.count(F.lit(1)).over(w)))
    d = d.withColumn("top_sum", F.max("plain_sum").over(W.partitionBy("g")))
    return _fuse(d, n, k).withColumn("position", F.row_number().over(W.partitionBy("g").orderBy(*_order())).cast("long"))


def _places(d: DataFrame, order: list[Column], parts: int, broadcast_rows: int) -> DataFrame:
    """Adds ``place``, from 1 in the given order within each group, by a sort over ``parts`` ranges."""
    by_range = d.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    # The generated id holds the partition above bit 33 and the place in the partition below.
    run = materialize(by_range.withColumn("__m", F.monotonically_increasing_id()), "p3-sorted").withColumn("__p", F.shiftright("__m", 33))
    starts = run.groupBy("g", "__p").agg(F.min("__m").alias("__lo"), F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy("g").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = materialize(starts.select("g", "__p", "__lo", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off")), "p3-starts")
    at = join_keys(run, starts, ["g", "__p"], "inner", "i", broadcast_rows)
    return at.withColumn("place", F.col("__m") - F.col("__lo") + F.col("__off") + 1).drop("__m", "__p", "__lo", "__off")


def _with_rank(d: DataFrame, j: int, parts: int, group_rows: int, broadcast_rows: int) -> DataFrame:
    """Adds ``r_j``: the last place of the row's value in its group."""
    s = f"s{j}"
    placed = _places(d.where(F.col(s).isNotNull()).select("g", "i", s), [F.col(s).desc(), F.col("i")], parts, broadcast_rows)
    ranks = materialize(placed.groupBy("g", s).agg(F.max("place").alias("__r"), F.count(F.lit(1)).alias("__c")), "p3-ranks")
    often = materialize(ranks.where(F.col("__c") > group_rows).select("g", s, F.col("__r").alias("__often")), "p3-often")
    d = join_keys(d, often, ["g", s], "left", "i", broadcast_rows)
    # Rows that need no partner in the second join are spread over its tasks.
    aside = F.col(s).isNull() | F.col("__often").isNotNull()
    d = d.withColumn("__aside", F.when(aside, F.pmod(F.xxhash64("i"), F.lit(4096)) + 1).otherwise(F.lit(0)))
    rest = ranks.where(F.col("__c") <= group_rows).select("g", s, "__r", F.lit(0).cast("long").alias("__aside"))
    return d.join(rest, ["g", s, "__aside"], "left").withColumn(f"r{j}", F.coalesce("__often", "__r")).drop("__often", "__r", "__aside")


def _large_groups(d: DataFrame, n: int, k: int, rows: int, group_rows: int, broadcast_rows: int) -> DataFrame:
    parts = -(-rows // group_rows)
    tops = materialize(d.groupBy("g").agg(F.max("plain_sum").alias("top_sum")), "p3-tops")
    ranked = join_keys(d, tops, ["g"], "inner", "i", broadcast_rows)
    for j in range(n):
        ranked = _with_rank(ranked, j, parts, group_rows, broadcast_rows)
    fused = materialize(_fuse(ranked, n, k), "p3-large")
    return _places(fused, _order(), parts, broadcast_rows).withColumnRenamed("place", "position")


def reciprocal_rank_fusion(
    df: DataFrame,
    group: str,
    item: str,
    scores: Sequence[str],
    position: str | None = None,
    version: str | None = None,
    k: int = 60,
    group_rows: int = GROUP_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``group, item, rank_<score>..., rrf_score, position, plain_sum, top_sum``, one row per item.

    ``position`` orders the group by the fused score; ties go by the given position (NULL last),
    then by item. ``plain_sum`` adds the scores (missing ones as 0), ``top_sum`` is the greatest in
    the group. NULL and NaN are missing. With ``version`` only the latest row of an item counts.
    Rows without group or item drop out. ``group_rows`` is the size up to which a group is ranked in
    one task. Other columns are ignored, whatever their names.
    """
    n = len(scores)
    rows = latest_scores(df, group, item, {f"s{j}": c for j, c in enumerate(scores)}, version, position)
    rows = materialize(rows.withColumn("plain_sum", sum((F.coalesce(f"s{j}", F.lit(0.0)) for j in range(n)), F.lit(0.0))), "p3-rows")
    large = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_rows), "p3-groups")
    in_large = large.agg(F.sum("c")).first()[0] or 0
    if in_large:
        ids = large.select("g")
        small = _small_groups(join_keys(rows, ids, ["g"], "left_anti", "i", broadcast_rows), n, k)
        d = materialize(join_keys(rows, ids, ["g"], "left_semi", "i", broadcast_rows), "p3-large-rows")
        parts = [small, _large_groups(d, n, k, in_large, group_rows, broadcast_rows)]
    else:
        parts = [_small_groups(rows, n, k)]
    names = [F.col(f"r{j}").alias(f"rank_{c}") for j, c in enumerate(scores)]
    cols = [F.col("g").alias(group), F.col("i").alias(item), *names, F.col("rrf").alias("rrf_score"), "position", "plain_sum", "top_sum"]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out
