"""Streams: the incremental session table fed by micro-batches, and prior figures with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.sessions import SessionTable
from newsloom.shared import new_path, ship_package


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def feed_sessions(stream: DataFrame, table: SessionTable, user: str, event_id: str, time: str) -> None:
    """Run the stream to its present end, each micro-batch through the session table. A batch that is
    replayed after a failure adds nothing, for the table knows the ids it has counted."""
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(lambda d, _: table.apply(d, user, event_id, time)).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def prior_clicks(stream: DataFrame, key: str = "user_id", time: str = "ts", click: str = "is_click", event_id: str = "event_id") -> DataFrame:
    """``key, time, prior`` for every event: clicks of its key before it, micro-batches in order of arrival
    and events of one in order of time and id. State is one number per key; a key's rows of one
    micro-batch are held together, as they come in chunks that are in no order."""
    ship_package(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    tkind = stream.schema[time].dataType.simpleString()

    def step(k, batches, state: GroupState):
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches), ignore_index=True).sort_values([time, event_id], kind="stable")
        run = pdf[click].astype("int64").cumsum()
        state.update((n + int(run.iloc[-1]),))
        yield pd.DataFrame({key: pdf[key], time: pdf[time], "prior": n + run - pdf[click].astype("int64")})

    return stream.select(key, time, click, event_id).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} {tkind}, prior long", "n long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream to its present end into parquet and read it."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_counts(stream: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts by type and tumbling window, with events later than the watermark left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
