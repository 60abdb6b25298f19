"""Work queues: selection, counts and deadlines over a table of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("ready", "scheduled", "leased", "acknowledged", "dead_lettered", "expired")
TERMINAL = ("acknowledged", "dead_lettered", "expired")
MAX_PRIORITY = 255


def active() -> Column:
    """Whether a message isn't at an end."""
    return ~F.col("state").isin(*TERMINAL)


def ready_order(messages: DataFrame, limit: int) -> DataFrame:
    """Ready messages by falling priority, then position."""
    return messages.filter("state = 'ready'").orderBy(F.desc("priority"), "commit_position").limit(limit)


def aged_priority(now_ms: int, interval_ms: int) -> Column:
    """Priority, raised by one for each interval of waiting."""
    waited = F.floor(F.greatest(F.lit(now_ms) - F.col("enqueued_at_ms"), F.lit(0)) / interval_ms)
    return F.least(F.col("priority") + waited, F.lit(MAX_PRIORITY)).cast("bigint")


def aged_order(messages: DataFrame, now_ms: int, interval_ms: int, limit: int, deferred: DataFrame | None = None) -> DataFrame:
    """Ready messages without session that aren't deferred, by falling aged priority, position and id."""
    rows = messages.filter("state = 'ready' AND session_id IS NULL")
    rows = rows.join(deferred, "id", "left_anti") if deferred is not None else rows
    return rows.withColumn("effective", aged_priority(now_ms, interval_ms)).orderBy(F.desc("effective"), "commit_position", "id").limit(limit)


def session_heads(messages: DataFrame, limit: int) -> DataFrame:
    """The first ready messages of each session, in order."""
    order = Window.partitionBy("session_id").orderBy("commit_position", "id")
    rows = messages.filter("state = 'ready' AND session_id IS NOT NULL").withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= limit)


def state_counts(messages: DataFrame) -> DataFrame:
    """Messages in each state, active ones, and the bytes they are charged, in one row."""
    return messages.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count_if(active()).alias("active"), F.coalesce(F.sum(F.when(active(), F.col("bytes"))), F.lit(0)).alias("active_bytes"))


def consumer_flow(messages: DataFrame) -> DataFrame:
    """Leased messages of each consumer and its latest term."""
    return messages.filter("state = 'leased'").groupBy("consumer").agg(F.count("*").alias("in_flight"), F.max("consumer_term").alias("term"))


def next_deadline(messages: DataFrame, max_age_ms: int | None) -> DataFrame:
    """When maintenance has something to do next: the least deadline of any active message."""
    age = F.col("enqueued_at_ms") + max_age_ms if max_age_ms is not None else F.lit(None).cast("bigint")
    each = F.least(F.when(F.col("state") == "scheduled", F.col("eligible_at_ms")), F.when(F.col("state") == "leased", F.col("deadline_ms")), F.col("enqueued_at_ms") + F.col("ttl_ms"), age)
    return messages.filter(active()).agg(F.min(each).alias("next_deadline_ms"))


def correlated(messages: DataFrame, correlation: str) -> DataFrame:
    """Active messages of a correlation, by position and id."""
    return messages.filter(active() & (F.col("correlation_id") == correlation)).orderBy("commit_position", "id")


def dead_letters(messages: DataFrame, limit: int) -> DataFrame:
    """Dead letters in the order in which they died."""
    return messages.filter("state = 'dead_lettered'").orderBy("dead_at_ms", "id").limit(limit)


def dead_letter(messages: DataFrame, letters: DataFrame, message_id: str) -> DataFrame:
    """The last letter (``id``, ``dead_at_ms``) of a message, if it is a dead letter now."""
    now = messages.filter((F.col("id") == message_id) & (F.col("state") == "dead_lettered")).select("id")
    return letters.join(now, "id", "left_semi").orderBy(F.desc("dead_at_ms")).limit(1)


def reconciled_letters(history: DataFrame, letters: DataFrame) -> DataFrame:
    """Dead-letter history with ``current``: whether the message is a dead letter now; letters without history are new rows."""
    known = letters.select(F.col("id").alias("_id")).distinct()
    old = history.join(known, F.col("id") == F.col("_id"), "left").withColumn("current", F.col("_id").isNotNull()).drop("_id").withColumn("fresh", F.lit(False))
    new = letters.join(history.select("id").distinct(), "id", "left_anti").select(*[c for c in history.columns]).withColumn("current", F.lit(True)).withColumn("fresh", F.lit(True))
    return old.unionByName(new)


def message(messages: DataFrame, message_id: str) -> DataFrame:
    """The message of an id, whatever its state, if there is one."""
    return messages.filter(F.col("id") == message_id)


def pending_forwards(letters: DataFrame, forwarded: DataFrame, limit: int) -> DataFrame:
    """Dead letters that haven't been forwarded, in the order in which they died."""
    return letters.join(forwarded.select("id").distinct(), "id", "left_anti").orderBy("dead_at_ms", "id").limit(limit)
