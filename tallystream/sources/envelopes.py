"""The event envelope, and the tables of a data folder as envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every record of the engine; a JSON null payload and a missing one are the same.
ENVELOPE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("source", T.StringType(), False), T.StructField("type", T.StringType(), False),
    T.StructField("subject", T.StringType()), T.StructField("time_ms", T.LongType(), False), T.StructField("key", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("content_type", T.StringType()),
    T.StructField("schema_ref", T.StringType()), T.StructField("traceparent", T.StringType()), T.StructField("payload", T.StringType()),
    T.StructField("deliver_at_ms", T.LongType()), T.StructField("ttl_ms", T.LongType()), T.StructField("priority", T.IntegerType()),
    T.StructField("dedupe_id", T.StringType()), T.StructField("transaction_id", T.StringType()), T.StructField("extensions", T.MapType(T.StringType(), T.StringType())),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unix_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def event_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as envelopes, with ``event_id`` and ``value`` beside; they are ordered by time and ``event_id``."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.lit("events").alias("source"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("subject"),
        unix_ms(F.col("ts")).alias("time_ms"), F.col("user_id").cast("string").alias("key"), F.create_map(F.lit("tenant"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))).alias("headers"),
        F.lit("application/json").alias("content_type"), F.lit(None).cast("string").alias("schema_ref"), F.lit(None).cast("string").alias("traceparent"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("payload"), F.lit(None).cast("bigint").alias("deliver_at_ms"), F.lit(None).cast("bigint").alias("ttl_ms"),
        (F.col("event_id") % 10).cast("int").alias("priority"), F.concat_ws(":", "user_id", "event_type").alias("dedupe_id"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("tx"), (F.col("event_id") % 7).cast("string"))).alias("transaction_id"), F.create_map().cast("map<string,string>").alias("extensions"),
        "event_id", "user_id", "value",
    )


def validated(envelopes: DataFrame) -> DataFrame:
    """Envelopes with ``problem``: why an envelope is rejected, or null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = F.when(blank("id"), "id").when(blank("source"), "source").when(blank("type"), "type").when(~F.coalesce("priority", F.lit(0)).between(0, 9), "priority")
    return envelopes.withColumn("problem", problem)


def read_json_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON Lines; a line that isn't one is an error."""
    return spark.read.schema(ENVELOPE).option("mode", "FAILFAST").json(path)
