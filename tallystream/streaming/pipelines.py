"""Streaming pipelines: appending with lasting offsets, publishing, and delivering once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tallystream.functions.hashes import partition_for
from tallystream.operators import bus


def append_stream(envelopes: DataFrame, partitions: int, order: str = "event_id") -> DataFrame:
    """A stream of envelopes as records, whose offsets go on across micro-batches.

    The state of a partition is its next offset and the largest append time:
    time never goes back, and nothing is late.
    """
    routed = envelopes.withColumn("partition", partition_for(F.col("key"), F.col("id"), partitions))
    schema = T.StructType([*routed.schema.fields, T.StructField("offset", T.LongType()), T.StructField("appended_at_ms", T.LongType())])
    names = [f.name for f in schema.fields]

    def number(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, watermark = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        rows["offset"] = range(following, following + len(rows))
        rows["appended_at_ms"] = rows["time_ms"].clip(lower=watermark).cummax()
        state.update((following + len(rows), max(watermark, int(rows["appended_at_ms"].max()))))
        yield rows[names]

    return routed.groupBy("partition").applyInPandasWithState(number, schema, "following long, watermark long", "append", "NoTimeout")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands every micro-batch with its number to ``write``; a batch may come again after a failure."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def publish(events: DataFrame, subscriptions: list[bus.Subscription], archive: str, outbox: str, checkpoint: str) -> DataStreamWriter:
    """Archives a stream of events and writes their deliveries to an outbox.

    Both lie in a folder of the batch's number that replaces one of the same
    number, so a batch that comes again isn't doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.write.mode("overwrite").parquet(f"{archive}/batch={number}")
        bus.fan_out(rows, subscriptions).write.mode("overwrite").parquet(f"{outbox}/batch={number}")
        rows.unpersist()

    return each_batch(events, write, checkpoint)


def deliver_once(batch: DataFrame, target: str, key: str = "delivery_id") -> DataFrame:
    """Appends the rows to the target whose key it doesn't have, and returns them.

    Settle their source afterwards: if that fails, the same rows are left out
    when they come again.
    """
    spark = batch.sparkSession
    once = batch.dropDuplicates([key])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        once = once.join(spark.read.parquet(target).select(key), key, "left_anti")
    folder = f"{target}/delivered={uuid.uuid4().hex}"
    once.write.parquet(folder)
    return spark.read.schema(once.schema).parquet(folder)
