"""Queries that run the state machines over commands made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions.retry import RetryPolicy
from tallystream.functions.sketches import CuckooFilter
from tallystream.plans.registry import query
from tallystream.sources.envelopes import table, unix_ms
from tallystream.streaming import drivers, folds

SHARDS = 16


def _log(rows: DataFrame, shard: Column, seq: Column, **fields: Column) -> DataFrame:
    """A command log; null fields are left out of the commands."""
    return rows.select(shard.cast("string").alias("shard"), seq.cast("bigint").alias("seq"), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("command"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("now", unix_ms(F.col("ts")))


def _counted(log: DataFrame, make) -> DataFrame:
    return drivers.run_batch(log, make).groupBy("shard").agg(F.count("*").alias("commands"), F.count_if("ok").alias("accepted"), F.sum(F.crc32("answer")).alias("digest"))


def queue_make() -> folds.QueueFold:
    """The queue of the query below."""
    return folds.QueueFold(folds.QueueConfig(visibility_ms=3_600_000, dedupe_window_ms=86_400_000, retry=RetryPolicy(max_attempts=3, max_age_ms=30 * 86_400_000)))


def queue_log(spark, sf_dir) -> DataFrame:
    """Events as a queue's commands: most enqueue, the others acquire, redrive or maintain."""
    e, kind = _events(spark, sf_dir), F.col("event_type")
    op = F.when(kind == "error", "maintain").when(kind == "purchase", "acquire").when(kind == "signup", "redrive").otherwise("enqueue")
    return _log(
        e, F.col("user_id") % SHARDS, F.col("event_id"), op=op, now_ms=F.col("now"), id=F.when(op == "redrive", (F.col("event_id") - 64).cast("string")).otherwise(F.col("event_id").cast("string")),
        priority=F.col("event_id") % 10, dedupe_id=F.when(F.col("event_id") % 3 == 0, F.concat_ws(":", "user_id", "event_type")), ttl_ms=F.when(F.col("event_id") % 4 == 0, F.lit(43_200_000)),
        consumer=F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")), max=1 + F.col("event_id") % 4,
    )


@query()
def queue_fold(spark, sf_dir):
    """A work queue of each shard: accepted commands and a digest of the answers."""
    return _counted(queue_log(spark, sf_dir), queue_make)


@query()
def delivery_fold(spark, sf_dir):
    """A delivery ledger of each shard."""
    e = _events(spark, sf_dir)
    op = F.when(F.col("event_id") % 4 == 3, "acquire").when(F.col("event_id") % 16 == 2, "maintain").otherwise("publish")
    log = _log(
        e, F.col("user_id") % SHARDS, F.col("event_id"), op=op, now_ms=F.col("now"), position=F.col("event_id"), subscriptions=F.array(F.lit("audit"), F.col("event_type")),
        subscription=F.when(F.col("event_id") % 3 == 0, "audit").otherwise(F.col("event_type")), dispatcher=F.lit("d"), max=F.lit(5),
    )
    return _counted(log, lambda: folds.DeliveryFold(RetryPolicy(max_attempts=2)))


@query()
def cache_txn_fold(spark, sf_dir):
    """A shard of keyed state with transactions and eviction."""
    e, kind = _events(spark, sf_dir), F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind == "purchase", "increment").when(kind == "signup", "access").otherwise("set")
    operation = F.array(F.struct(op.alias("op"), F.concat_ws(":", F.when(kind == "purchase", "n").otherwise("s"), "user_id").alias("key"), F.col("props").alias("value"), F.when(F.col("event_id") % 3 == 0, 86_400_000).alias("ttl_ms")))
    log = _log(e, F.col("user_id") % SHARDS, F.col("event_id"), op=F.lit("transact"), now_ms=F.col("now"), operations=operation)
    return _counted(log, lambda: folds.CacheFold(folds.CacheConfig(max_entries=12, policy="all_keys_lru")))


@query()
def consumer_session_fold(spark, sf_dir):
    """Consumer groups whose members come, stay and go."""
    e, kind = _events(spark, sf_dir), F.col("event_type")
    op = F.when(kind.isin("click", "view"), "join").when(kind == "error", "maintain").when(kind == "signup", "leave").otherwise("heartbeat")
    log = _log(e, F.col("user_id") % SHARDS, F.col("event_id"), op=op, now_ms=F.col("now"), member=F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")), timeout_ms=F.lit(300_000), generation=F.col("event_id") % 50)
    return _counted(log, lambda: folds.SessionFold(SHARDS))


@query()
def producer_fold(spark, sf_dir):
    """Idempotent producers, some of whose appends repeat or leave gaps."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.withColumn("n", n)
    log = _log(e, F.col("user_id") % SHARDS, F.col("event_id"), op=F.lit("append"), now_ms=F.col("now"), producer=F.col("user_id").cast("string"), term=F.lit(1), sequence=F.when(F.col("event_id") % 29 == 0, F.greatest(F.col("n") - 1, F.lit(0))).otherwise(F.col("n")), digest=F.col("event_type"))
    return _counted(log, folds.ProducerFold)


@query()
def lock_fold(spark, sf_dir):
    """Locks that owners of several terms try to take."""
    e = _events(spark, sf_dir)
    log = _log(e, F.col("user_id") % SHARDS, F.col("event_id"), op=F.lit("acquire"), now_ms=F.col("now"), lock=F.col("event_type"), owner=F.col("user_id").cast("string"), owner_term=1 + F.col("event_id") % 3, lease_ms=F.lit(7_200_000))
    return _counted(log, folds.LockFold)


@query()
def registry_fold(spark, sf_dir):
    """Desired resources that are applied and deleted."""
    e = _events(spark, sf_dir)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("apply")
    log = _log(e, F.col("user_id") % SHARDS, F.col("event_id"), op=op, now_ms=F.col("now"), name=F.col("user_id").cast("string"), spec=F.col("event_type"), token=(F.col("event_id") % 5_000).cast("string"))
    return _counted(log, folds.RegistryFold)


@query()
def offset_fold(spark, sf_dir):
    """Offsets of consumer groups that are committed and reset."""
    e = _events(spark, sf_dir)
    op = F.when(F.col("event_type") == "error", "reset").otherwise("commit")
    log = _log(e, F.col("user_id") % SHARDS, F.col("event_id"), op=op, now_ms=F.col("now"), partition=F.col("user_id") % 9, offset=F.col("event_id") % 1_000)
    return _counted(log, lambda: folds.OffsetFold({str(p): [10 * p, 800 + 20 * p] for p in range(8)}))


@query()
def cuckoo_fold(spark, sf_dir):
    """Cuckoo filters of each shard: what was new, known, refused or deleted."""
    import pandas as pd

    e = table(spark, sf_dir, "events").select((F.col("user_id") % SHARDS).cast("string").alias("shard"), "event_id", F.col("user_id").cast("string").alias("value"), (F.col("event_type") == "error").alias("gone"))

    def run(batches):
        shard, bloom = None, None
        for batch in batches:
            rows = []
            for s, _, value, gone in batch.itertuples(index=False):
                if s != shard:
                    shard, bloom = s, CuckooFilter(32, 4)
                try:
                    outcome = ("deleted" if bloom.delete(value.encode()) else "absent") if gone else ("added" if bloom.add(value.encode()) else "known")
                except OverflowError:
                    outcome = "full"
                rows.append((s, outcome))
            yield pd.DataFrame(rows, columns=["shard", "outcome"])

    found = e.repartition("shard").sortWithinPartitions("shard", "event_id").mapInPandas(run, "shard string, outcome string")
    return found.groupBy("shard", "outcome").agg(F.count("*").alias("n"))
