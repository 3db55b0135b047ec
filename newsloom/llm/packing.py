"""Filling fixed-capacity containers with items.

Method: best-two-fit. A container is filled greedily, always with the largest item that still
fits; then its smallest item is replaced by two unpacked items that fit the widened gap more
tightly, as long as that gains.

Items are spread over shards of a bounded number of items, each packed on its own: the work per
container depends on the number of distinct sizes, at most the capacity, and only the last
containers of a shard stay partly empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.shared import materialize, ship_package


class _Pool:
    """Unpacked items by size: stacks of item numbers and the sorted sizes that remain."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.by_size: dict[int, list[int]] = {}
        for x in order[::-1]:
            self.by_size.setdefault(int(sizes[x]), []).append(int(x))
        self.sizes = np.array(sorted(self.by_size), dtype=np.int64)
        self.n = len(sizes)

    def largest(self, room: int) -> int:
        """The largest remaining size within room, or 0."""
        k = int(np.searchsorted(self.sizes, room, side="right"))
        return int(self.sizes[k - 1]) if k else 0

    def take(self, size: int) -> int:
        stack = self.by_size[size]
        item = stack.pop()
        self.n -= 1
        if not stack:
            del self.by_size[size]
            self.sizes = np.delete(self.sizes, np.searchsorted(self.sizes, size))
        return item

    def give(self, size: int, item: int) -> None:
        if size not in self.by_size:
            self.by_size[size] = []
            self.sizes = np.insert(self.sizes, np.searchsorted(self.sizes, size), size)
        self.by_size[size].append(item)
        self.n += 1

    def best_two(self, room: int) -> tuple[int, int]:
        """Two sizes whose sum is the largest within room, or (0, 0)."""
        a = self.sizes[: np.searchsorted(self.sizes, room, side="left")]
        if not len(a):
            return 0, 0
        k = np.searchsorted(self.sizes, room - a, side="right") - 1
        b = np.where(k >= 0, self.sizes[np.maximum(k, 0)], 0)
        alone = np.fromiter((len(self.by_size[int(x)]) == 1 for x in a), bool, len(a))
        same = (b == a) & alone  # a single item can't be both: the next smaller partner
        b = np.where(same, np.where(k >= 1, self.sizes[np.maximum(k - 1, 0)], 0), b)
        total = np.where(b > 0, a + b, 0)
        best = int(np.argmax(total))
        return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; all sizes must be 1..capacity."""
    pool, out, box = _Pool(np.asarray(sizes)), np.full(len(sizes), -1, dtype=np.int64), 0
    while pool.n:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while s := pool.largest(gap):
            inside.append((s, pool.take(s)))
            gap -= s
        while gap and pool.n >= 2:
            small, item = inside[-1]
            a, b = pool.best_two(gap + small)
            if a + b <= small:
                break
            inside[-1:] = sorted([(a, pool.take(a)), (b, pool.take(b))], reverse=True)
            pool.give(small, item)
            inside.sort(reverse=True)
            gap += small - a - b
            while s := pool.largest(gap):
                inside.append((s, pool.take(s)))
                gap -= s
            inside.sort(reverse=True)
        for _, item in inside:
            out[item] = box
        box += 1
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int = 2048, shard_items: int = 20_000) -> DataFrame:
    """``item_id, piece, n_tokens, container_id``: every item in one container, or, if it is longer
    than a container, in full containers of its own plus one for the rest.

    ``piece`` counts from 1. Items of size 0 or NULL hold nothing and go to no container
    (``container_id`` NULL). Item ids should be unique; repeated rows are items of their own. An
    item without id is packed like any other. ``container_id`` is unique over all shards. Other
    columns are ignored.
    """
    ship_package(items.sparkSession)
    kind = items.select(item_id).schema[0].dataType.simpleString()
    src = items.select(F.col(item_id).alias("__i"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__n"))
    src = materialize(src, "p7-sizes")
    n = src.count()
    shards = max(1, math.ceil(n / shard_items))
    # Full containers need no packing: they follow from the size alone.
    full = F.floor(F.col("__n") / capacity).cast("long")
    uid = F.monotonically_increasing_id()
    num = materialize(src.withColumn("__u", uid), "p7-items")
    long_ = num.where(F.col("__n") > capacity).select("__i", "__u", F.explode(F.sequence(F.lit(1), full.cast("int"))).alias("piece"))
    whole = long_.select("__i", "piece", F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("f"), F.col("__u"), F.col("piece")).alias("container_id"))
    rest = num.select("__i", "__u", F.when(F.col("__n") > capacity, F.col("__n") % capacity).otherwise(F.col("__n")).alias("s"), F.when(F.col("__n") > capacity, full + 1).otherwise(1).cast("int").alias("piece"))
    empty = rest.where("s = 0 AND piece = 1").select("__i", "piece", F.col("s").alias("n_tokens"), F.lit(None).cast("string").alias("container_id"))
    todo = rest.where("s > 0").withColumn("shard", F.pmod(F.xxhash64("__u"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "__u"]).reset_index(drop=True)
        box = pack_sizes(pdf["s"].to_numpy(), capacity)
        shard = int(pdf["shard"].iat[0])
        return pd.DataFrame({"__i": pdf["__i"], "piece": pdf["piece"], "n_tokens": pdf["s"], "container_id": [f"s-{shard}-{b}" for b in box]})

    packed = todo.groupBy("shard").applyInPandas(run, f"__i {kind}, piece int, n_tokens long, container_id string")
    return packed.unionByName(whole).unionByName(empty).withColumnRenamed("__i", item_id)
