"""Durable intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Tables are
written as parquet, so a lost executor costs no lineage. Only a local session
without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import io
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: at most so many rows of a table of keys are broadcast
BROADCAST_ROWS = 200_000

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        own = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _LOCAL[app] = f"file://{own}"
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_all(spark: SparkSession) -> None:
    """Remove every intermediate table this application made; results read from them end here."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        drop_path(spark, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by keys into the session's number of shuffle partitions, which adaptive execution
    keeps: for rows that are few but multiply in the next join."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes):
    p, fs = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return p, fs


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if there is none."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file that must not exist yet, in one rename; False if another writer came first."""
    jvm = spark.sparkContext._jvm
    tmp, fs = write_bytes(spark, f"{path}.{uuid.uuid4().hex[:12]}.tmp", data)
    dst, _ = hadoop_path(spark, path)
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    opts = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    opts[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        fc.rename(tmp, dst, opts)
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if fs.exists(dst):
            return False
        raise e
    return True


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = f"{new_path(spark, 'package')}/{root.name}.zip"
    write_bytes(spark, path, buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def store(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to ``path`` and return a DataFrame that reads it back."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    return store(df, new_path(df.sparkSession, name), *partition_by)


def ship_table(df: DataFrame, name: str) -> str:
    """Store ``df`` where every executor can read it whole, without a row passing through the driver's memory;
    ``shipped`` finds its files on an executor. A folder that is no local path is fetched once by each."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    if path.startswith("file:"):
        return path
    df.sparkSession.sparkContext.addFile(path, recursive=True)
    return path.rsplit("/", 1)[1]


def shipped(name: str) -> list[str]:
    """The files of a table given to ``ship_table``, on an executor."""
    from pyspark import SparkFiles

    root = pathlib.Path(re.sub("^file:/+", "/", name) if name.startswith("file:") else SparkFiles.get(name))
    return sorted(str(f) for f in root.glob("*.parquet"))


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (NULL stays NULL)."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise TypeError("pass the column name")
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{name}` AS TIMESTAMP_NTZ))")


def number(c: Column) -> Column:
    """A score as double in which NaN counts as missing."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key. Repeats collapse before the shuffle (window group limit), so a
    group of copies of any size never meets in one task."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def may_match(df: DataFrame, others: DataFrame, keys: list[str], words: int = 1 << 19) -> DataFrame:
    """The rows of ``df`` whose keys may stand in ``others``: all that do, and few others. A bitmap of
    64 * ``words`` hashes is broadcast, of fixed size (8 MB) whatever the size of ``others``; so rows are
    sifted before a shuffle and the exact join comes after it. NULL keys count like any other."""
    h = F.pmod(F.xxhash64(*keys), F.lit(words * 64))
    bit = F.expr("shiftleft(1L, CAST(`__h` & 63 AS INT))")
    bits = others.select(h.alias("__h")).groupBy(F.shiftright("__h", 6).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    sifted = df.withColumn("__h", h).withColumn("__w", F.shiftright("__h", 6)).join(F.broadcast(bits), "__w")
    return sifted.where(F.col("__bits").bitwiseAND(bit) != 0).drop("__h", "__w", "__bits")


def join_keys(rows: DataFrame, table: DataFrame, keys: list[str], how: str, by: str, broadcast_rows: int = BROADCAST_ROWS, pieces: int = 256) -> DataFrame:
    """Join rows of any skew with a stored table of distinct keys: by broadcast while the table has at
    most ``broadcast_rows`` rows, else in ``pieces`` that part the rows of a key by the column ``by``."""
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(table), keys, how)
    parted = rows.withColumn("__piece", F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int"))
    return parted.join(table.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))), [*keys, "__piece"], how).drop("__piece")
