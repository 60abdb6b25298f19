"""Subscriptions: filters, fan-out, transforms, targets and the delivery ledger's queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions import matching
from tallystream.operators.ordered import as_of

MAX_REPLAY = 10_000
#: Milliseconds of events that are sorted in one task.
BUCKET_MS = 3_600_000
#: Messages that wait for a channel subscription at most.
RING = 1_024


@dataclass(frozen=True)
class EventFilter:
    """A conjunction; an empty part passes everything."""

    types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    headers: tuple[tuple[str, str], ...] = ()
    json: tuple[tuple[str, str], ...] = ()

    def column(self) -> Column:
        """The filter as a condition that is never null."""
        legs = [matching.any_glob(F.col(c), list(p)) for c, p in (("type", self.types), ("source", self.sources), ("subject", self.subjects)) if p]
        legs += [F.coalesce(F.col("headers")[k] == v, F.lit(False)) for k, v in self.headers]
        legs += [matching.json_equals(F.col("payload"), path, value) for path, value in self.json]
        return reduce(lambda a, b: a & b, legs) if legs else F.lit(True)


@dataclass(frozen=True)
class Subscription:
    """A named filter with a target, headers to add, and payload fields to take from paths."""

    name: str
    filter: EventFilter = field(default_factory=EventFilter)
    target: str = "pull"
    add_headers: tuple[tuple[str, str], ...] = ()
    projection: tuple[tuple[str, str], ...] = ()

    def headers(self) -> Column:
        """The headers with the added ones in place of those of their name."""
        if not self.add_headers:
            return F.col("headers")
        added = F.create_map(*[F.lit(x) for pair in sorted(self.add_headers) for x in pair])
        names = [k for k, _ in self.add_headers]
        return F.map_concat(F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(names)), added)

    def payload(self) -> Column:
        """The payload's projection: fields in order of name, those without source left out, a null kept."""
        if not self.projection:
            return F.col("payload")
        parts = [F.concat(F.lit(f'"{name}":'), matching.json_value(F.col("payload"), path)) for name, path in sorted(self.projection)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fan_out(events: DataFrame, subscriptions: list[Subscription]) -> DataFrame:
    """An event for each subscription that it matches: with ``subscription``, ``target``, and its own headers and payload.

    Filters are compiled once, and an event is read once: the matching
    subscriptions are an array of structs that is exploded.
    """
    ordered = sorted(subscriptions, key=lambda s: s.name)
    routes = [F.when(s.filter.column(), F.struct(F.lit(s.name).alias("subscription"), F.lit(s.target).alias("target"), s.headers().alias("headers"), s.payload().alias("payload"))) for s in ordered]
    matched = F.filter(F.array(*routes), lambda r: r.isNotNull())
    rows = events.withColumn("_route", F.explode(matched))
    return rows.drop("headers", "payload").select("*", "_route.*").drop("_route")


def replay(archive: DataFrame, start_ms: int, end_ms: int, condition: EventFilter | None = None, limit: int = MAX_REPLAY) -> DataFrame:
    """Archived events received within both bounds, in position order."""
    if not 1 <= limit <= MAX_REPLAY:
        raise ValueError("a replay has 1 to 10,000 events")
    rows = archive.filter(F.col("time_ms").between(start_ms, end_ms))
    return (rows.filter(condition.column()) if condition else rows).orderBy("position").limit(limit)


def plan_in_force(events: DataFrame, changes: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Events with the ``version`` of the routes when they came: the last change (``at_ms``, ``version``) up to their time, 0 before any."""
    return as_of(events, "time_ms", changes, "at_ms", "version", bucket_ms).withColumn("version", F.coalesce("version", F.lit(0)))


def channel_fan_out(messages: DataFrame, subscribers: dict[str, tuple[list[str], list[str]]], order: str, ring: int = RING) -> DataFrame:
    """Waiting and dropped messages of channel subscribers (``subscriber`` to channels and byte globs) that haven't polled.

    The first ``ring`` messages of each wait and newer ones are dropped, so
    columns ``subscriber``, ``pending``, ``dropped`` and the last waiting message's
    ``last_order`` follow.
    """
    routes = []
    for name, (channels, patterns) in sorted(subscribers.items()):
        legs = [F.col("channel").isin(channels)] if channels else []
        legs += [matching.byte_glob_matches(F.col("channel"), p) for p in patterns]
        routes.append(F.when(reduce(lambda a, b: a | b, legs) if legs else F.lit(False), F.lit(name)))
    rows = messages.select(F.col(order).alias("_order"), F.explode(F.filter(F.array(*routes), lambda r: r.isNotNull())).alias("subscriber"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("subscriber").orderBy("_order"))).filter(F.col("_rank") <= ring)
    total = rows.groupBy("subscriber").agg(F.count("*").alias("n"))
    last = ranked.groupBy("subscriber").agg(F.max("_order").alias("last_order"))
    return total.join(last, "subscriber").select("subscriber", F.least("n", F.lit(ring)).alias("pending"), F.greatest(F.col("n") - ring, F.lit(0)).alias("dropped"), "last_order")


def executed(routes: DataFrame, resources: DataFrame) -> DataFrame:
    """The ``status`` of each route by its target: ``queue:name`` and ``stream:name`` must exist, others wait outside."""
    known = resources.select(F.concat_ws(":", "kind", "name").alias("_known")).distinct()
    inside = F.col("target").startswith("queue:") | F.col("target").startswith("stream:")
    # Other targets, which most routes may share, get keys of their own, so that they don't meet in one task.
    plain = [c for c, t in routes.dtypes if not t.startswith(("map", "variant"))]
    key = F.when(inside, F.col("target")).otherwise(F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string")))
    rows = routes.join(known, key == F.col("_known"), "left")
    status = F.when(inside & F.col("_known").isNotNull(), "delivered").when(inside, "target_missing").when(F.col("target") == "pull", "pull_available").otherwise("pending_external_delivery")
    return rows.withColumn("status", status).drop("_known")


def candidates(deliveries: DataFrame, now_ms: int, window: int) -> DataFrame:
    """Deliveries that may start now, in order, as far as each subscription's window has room."""
    busy = deliveries.filter("state = 'in_flight'").groupBy(F.col("subscription").alias("_s")).agg(F.count("*").alias("_busy"))
    due = deliveries.filter((F.col("state") == "pending") & (F.col("eligible_at_ms") <= now_ms))
    order = Window.partitionBy("subscription").orderBy("publish_position", "delivery_id")
    rows = due.withColumn("place", F.row_number().over(order)).join(busy, F.col("subscription") == F.col("_s"), "left")
    return rows.filter(F.col("place") <= window - F.coalesce("_busy", F.lit(0))).drop("_s", "_busy")


def delivery(deliveries: DataFrame, delivery_id: str) -> DataFrame:
    """The delivery of an id, if there is one."""
    return deliveries.filter(F.col("delivery_id") == delivery_id)


def subscriptions_after(commands: DataFrame) -> DataFrame:
    """Subscriptions after all upserts and removals (``name``, ``seq``, ``filter``, null for a removal), with the version of each."""
    last = commands.groupBy("name").agg(F.max_by(F.struct("filter"), "seq").alias("last"), F.count_if(F.col("filter").isNotNull()).alias("upserts"))
    return last.select("name", F.col("last.filter").alias("filter"), "upserts").filter("filter IS NOT NULL")


def lease_sweep(deliveries: DataFrame, now_ms: int, max_attempts: int, limit: int) -> DataFrame:
    """Deliveries whose lease is over, by deadline and id, with the state they get: ``pending`` again, or ``dead_lettered`` after the last attempt."""
    late = deliveries.filter((F.col("state") == "in_flight") & (F.col("lease_until_ms") <= now_ms))
    after = F.when(F.col("attempt") >= max_attempts, "dead_lettered").otherwise("pending")
    return late.orderBy("lease_until_ms", "delivery_id").limit(limit).withColumn("state_after", after)


def counts(deliveries: DataFrame, states: tuple[str, ...] = ("pending", "in_flight", "acknowledged", "dead_lettered")) -> DataFrame:
    """Deliveries in each state, in one row."""
    return deliveries.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
