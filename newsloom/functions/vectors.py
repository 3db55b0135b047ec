"""Vector expressions over array<double> inside the JVM, and sums of lists of vectors in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.shared import ship_package


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda an outer expression would be computed
    again for every element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """a over its length; a vector shorter than 1e-12 stays as it is."""
    return let(a, lambda v: let(F.when(norm(v) > 1e-12, norm(v)).otherwise(F.lit(1.0)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def fuse(content: Column, entity: Column, weight: float = 1.0) -> Column:
    """Unit content and weighted unit entity block side by side, as a unit vector. A zero entity
    block changes no cosine."""
    return unit(F.concat(unit(content), scale(unit(entity), F.lit(weight))))


def reduce_lists(rows: DataFrame, key: str, size_bound: str, out: str, kind: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """``key, out`` of rows (key, ord, w, vec): each key's vectors, in order of ``ord``, go to ``fn`` as
    weights, a matrix and the first row of every key, all keys of an Arrow batch at once. A key's vectors
    are held together, so their number must be bounded: ``size_bound`` says by what."""
    assert size_bound
    ship_package(rows.sparkSession)
    t = rows.schema[key].dataType.simpleString()
    z = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("w").cast("double").alias("w"), F.col("vec").cast("array<double>").alias("vec")))).alias("z"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            starts = np.asarray(lists.offsets)
            flat = lists.flatten()
            w = flat.field("w").to_numpy(zero_copy_only=False)
            m = flat.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), fn(w, m, starts[:-1] - starts[0])], names=[key, out])

    return z.mapInArrow(run, f"{key} {t}, {out} {kind}")


def as_lists(m: np.ndarray) -> pa.Array:
    """A matrix as an array of lists."""
    n, d = m.shape
    return pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), m.ravel())


def _summed(keys: pa.Array, m: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys in order of appearance with the sums of their rows."""
    enc = keys.dictionary_encode()
    at = enc.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return enc.dictionary, np.add.reduceat(m[order], first)


def sum_vectors(rows: DataFrame, key: str) -> DataFrame:
    """``key, vec``: for rows (key, w, vec) the sum of w * vec of every key. Tasks add up what they hold before
    the shuffle, and after it in order of key, so a key of any number of rows is never held whole."""
    ship_package(rows.sparkSession)
    t = rows.schema[key].dataType.simpleString()

    def matrix(vecs: pa.Array, n: int) -> np.ndarray:
        return vecs.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def batch(keys: pa.Array, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, as_lists(m)], names=[key, "vec"])

    def partial(batches):
        for b in batches:
            if b.num_rows:
                yield batch(*_summed(b.column(0), matrix(b.column(2), b.num_rows) * b.column(1).to_numpy(zero_copy_only=False)[:, None]))

    def final(batches):
        held = None  # the last key, whose rows may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            keys, m = _summed(b.column(0), matrix(b.column(1), b.num_rows))
            if held is not None:
                if held[0][0].equals(keys[0]):
                    m[0] += held[1][0]
                else:
                    yield batch(*held)
            if len(keys) > 1:
                yield batch(keys[:-1], m[:-1])
            held = keys[-1:], m[-1:]
        if held is not None:
            yield batch(*held)

    schema = f"{key} {t}, vec array<double>"
    parts = rows.select(key, F.col("w").cast("double").alias("w"), F.col("vec").cast("array<double>").alias("vec")).where(F.col(key).isNotNull()).mapInArrow(partial, schema)
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(final, schema)
