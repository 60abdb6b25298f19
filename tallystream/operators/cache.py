"""Keyed state: folds of last writes, change history, eviction and typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions import hashes
from tallystream.operators.ordered import PER_BUCKET, carried, number_bucket, running_total

#: Bytes that an entry is charged beyond its key and value.
ENTRY_BYTES = 40
#: Domain of random eviction ranks.
EVICTION_DOMAIN = b"tallystream/eviction-rank/v1\0"


def last_writes(changes: DataFrame) -> DataFrame:
    """The live entries after all changes (``key``, ``revision``, ``value``, null for a delete).

    Only the latest change of a key leaves each task.
    """
    last = changes.groupBy("key").agg(F.max_by(F.struct("value", "revision"), "revision").alias("last"), F.count("*").alias("versions"))
    return last.select("key", "last.value", "last.revision", "versions").filter("value IS NOT NULL")


def change_images(changes: DataFrame, per_bucket: int | None = PER_BUCKET) -> DataFrame:
    """Changes with the value ``before`` each; those that change nothing are left out."""
    rows = carried(changes, ["key"], "revision", F.col("value"), "before", per_bucket, latest=True)
    return rows.filter(~F.col("before").eqNullSafe(F.col("value")))


def at_revision(current: DataFrame, images: DataFrame, revision: int) -> DataFrame:
    """The entries at an earlier revision: the image before the first later change of a key, else the current one."""
    later = images.filter(F.col("revision") > revision).groupBy(F.col("key").alias("_k")).agg(F.min_by(F.struct("before"), "revision").alias("_first"))
    rows = current.select("key", "value").join(later, F.col("key") == F.col("_k"), "full_outer")
    value = F.when(F.col("_k").isNotNull(), F.col("_first.before")).otherwise(F.col("value"))
    return rows.select(F.coalesce("key", "_k").alias("key"), value.alias("value")).filter("value IS NOT NULL")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose value differs between two states, with both and the ``kind`` of change."""
    a, b = before.select("key", F.col("value").alias("before")), after.select("key", F.col("value").alias("after"))
    rows = a.join(b, "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return rows.withColumn("kind", F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated"))


def entry_bytes() -> Column:
    """Bytes that an entry is charged."""
    return F.octet_length("key") + F.octet_length("value") + ENTRY_BYTES


def of_class(entries: DataFrame, storage_class: str) -> DataFrame:
    """All entries of a storage class, expired ones too, by key."""
    return entries.filter(F.col("storage_class") == storage_class).orderBy("key")


def class_bytes(entries: DataFrame) -> DataFrame:
    """Entries and charged bytes of each storage class."""
    return entries.groupBy("storage_class").agg(F.count("*").alias("entries"), F.sum(entry_bytes().cast("bigint")).alias("bytes"))


def eviction_rank(policy: str, revision: int = 0) -> list[Column]:
    """What an eviction policy orders entries by; ties go by key."""
    kind = policy.removeprefix("all_keys_").removeprefix("volatile_")
    ranks = {
        "lru": [F.col("last_access_revision")], "lfu": [F.col("access_count"), F.col("last_access_revision")], "ttl": [F.col("expires_at_ms").asc_nulls_last()],
        "random": [F.sha2(F.concat(F.lit(EVICTION_DOMAIN), F.unhex(F.lpad(F.hex(F.lit(revision).cast("bigint")), 16, "0")), F.encode("key", "UTF-8")), 256)],
    }
    if kind not in ranks:
        raise ValueError(f"unknown policy {policy}")
    return ranks[kind]


def victims(entries: DataFrame, policy: str, count: int, revision: int = 0) -> DataFrame:
    """The ``count`` entries that a policy evicts first; volatile policies only take entries that expire."""
    pool = entries.filter("expires_at_ms IS NOT NULL") if policy.startswith("volatile_") else entries
    return pool.orderBy(*eviction_rank(policy, revision), "key").limit(count)


def byte_victims(entries: DataFrame, rank: list[str], budgets: dict[str, int], per_bucket: int | None = PER_BUCKET) -> DataFrame:
    """The entries that leave until each class keeps to its budget: in rank order, as long as what is left is too much.

    The first of ``rank`` is a number, or ``per_bucket`` is None and a class one task's.
    """
    bucket = None if per_bucket is None else number_bucket(rank[0], per_bucket)
    total = entries.groupBy("storage_class").agg(F.sum(entry_bytes().cast("bigint")).alias("_all"))
    rows = running_total(entries, ["storage_class"], [*rank, "key"], entry_bytes().cast("bigint"), "_gone", bucket).join(total, "storage_class")
    budget = F.coalesce(*[F.when(F.col("storage_class") == c, F.lit(b)) for c, b in budgets.items()])
    return rows.filter(F.col("_all") - (F.col("_gone") - entry_bytes()) > budget).drop("_all", "_gone")


def expired(entries: DataFrame, now_ms: int, limit: int = 1_000) -> DataFrame:
    """Entries whose deadline is over, by deadline and key."""
    return entries.filter(F.col("expires_at_ms") <= now_ms).orderBy("expires_at_ms", "key").limit(limit)


def live(entries: DataFrame, now_ms: int) -> DataFrame:
    """Entries that a reader sees now; a deadline itself is over."""
    return entries.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))


def get(entries: DataFrame, key: str, now_ms: int) -> DataFrame:
    """The entry of a key that a reader sees now, if there is one."""
    return live(entries.filter(F.col("key") == key), now_ms)


def journal(log: DataFrame, since: int, limit: int = 1_000) -> DataFrame:
    """A command log (``version``, ``seq``) from a version on, in order."""
    return log.filter(F.col("version") >= since).orderBy("version", "seq").limit(limit)


def deadline(now: Column, ttl: Column, default_ttl_ms: int | None) -> Column:
    """When an entry written now expires; a time to live of 0 or less is an error."""
    used = F.coalesce(ttl, F.lit(default_ttl_ms).cast("bigint"))
    return F.when(used <= 0, F.raise_error(F.lit("time to live must be positive")).cast("bigint")).otherwise(now + used)


def counters(increments: DataFrame) -> DataFrame:
    """The sum of the deltas of each key; an overflow is an error."""
    return increments.groupBy("key").agg(F.sum("delta").alias("counter"))


def hash_fields(puts: DataFrame) -> DataFrame:
    """Each key's map of fields: the last put of a field, null for a removed one, in field order."""
    last = puts.groupBy("key", "field").agg(F.max_by(F.struct("value"), "seq").alias("last")).filter("last.value IS NOT NULL")
    return last.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", F.col("last.value").alias("value")))).alias("fields"))


def sorted_sets(adds: DataFrame) -> DataFrame:
    """Each key's members with their last score, in member order; a score that isn't finite is an error."""
    score = F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.raise_error(F.lit("score must be finite")).cast("double")).otherwise(F.col("score"))
    last = adds.withColumn("score", score).groupBy("key", "member").agg(F.max_by(F.struct("score"), "seq").alias("last")).filter("last.score IS NOT NULL")
    return last.select("key", "member", "last.score")


def sets_after(changes: DataFrame) -> DataFrame:
    """Members of each key's set: those whose last change added them."""
    last = changes.groupBy("key", "member").agg(F.max_by("added", "seq").alias("added")).filter("added")
    return last.select("key", "member")


def proposals(commands: DataFrame, domain: str) -> DataFrame:
    """The first command of each idempotency key, with its ``proposal_id``; later ones replay it."""
    rank = Window.partitionBy("idempotency_key").orderBy("seq")
    rows = commands.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
    return rows.withColumn("proposal_id", hashes.proposal_id(domain, F.col("idempotency_key")))
