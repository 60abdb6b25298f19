"""Queries over subscriptions, channels and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystream.functions import matching, retry
from tallystream.operators import bus, stream
from tallystream.plans.registry import ENVELOPES, query
from tallystream.sources.envelopes import event_envelopes

SUBSCRIPTIONS = [
    bus.Subscription("all", target="stream:archive"),
    bus.Subscription("audit", bus.EventFilter(types=("*r*",), headers=(("tenant", "t1"),)), "queue:audit", (("routed-by", "audit"), ("tenant", "masked"))),
    bus.Subscription("buyers", bus.EventFilter(types=("purchase", "sign??"), sources=("event*",)), "queue:orders", projection=(("amount", "$.k"), ("none", "k.deep"))),
    bus.Subscription("sevens", bus.EventFilter(json=(("k", "7"),)), "https://hooks.example.com/7"),
    bus.Subscription("floats", bus.EventFilter(json=(("k", "7.0"),))),
    bus.Subscription("subjects", bus.EventFilter(subjects=("*",))),
]
_ROUTES = f"""WITH {ENVELOPES}, j AS (SELECT *, TRY_CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM env),
routes AS (
  SELECT 'all' AS subscription, 'stream:archive' AS target, * FROM j
  UNION ALL SELECT 'audit', 'queue:audit', * FROM j WHERE contains(type, 'r') AND tenant = 't1'
  UNION ALL SELECT 'buyers', 'queue:orders', * FROM j WHERE type = 'purchase' OR regexp_full_match(type, '(?s)sign..')
  UNION ALL SELECT 'sevens', 'https://hooks.example.com/7', * FROM j WHERE k = 7)"""


@query(_ROUTES + " SELECT event_id, subscription, target FROM routes")
def route_fanout(spark, sf_dir):
    """Events with the subscriptions that they match."""
    return bus.fan_out(event_envelopes(spark, sf_dir), SUBSCRIPTIONS).select("event_id", "subscription", "target")


@query(_ROUTES + """ SELECT event_id, subscription, CASE subscription WHEN 'audit' THEN 'routed-by=audit,tenant=masked' ELSE 'tenant=' || tenant END AS headers,
CASE WHEN subscription <> 'buyers' THEN payload WHEN k IS NULL THEN '{}' ELSE '{"amount":' || k || '}' END AS payload FROM routes WHERE subscription <> 'all'""")
def route_transform(spark, sf_dir):
    """Routed events with their added headers and projected payloads."""
    rows = bus.fan_out(event_envelopes(spark, sf_dir), SUBSCRIPTIONS).filter("subscription <> 'all'")
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return rows.select("event_id", "subscription", F.array_join(pairs, ",").alias("headers"), "payload")


@query(_ROUTES + """ SELECT status, count(*) AS routes FROM (SELECT CASE WHEN target IN ('stream:archive', 'queue:orders') THEN 'delivered' WHEN target = 'queue:audit' THEN 'target_missing' WHEN target = 'pull' THEN 'pull_available' ELSE 'pending_external_delivery' END AS status FROM routes) GROUP BY 1""")
def target_execution(spark, sf_dir):
    """Routes by what becomes of them."""
    rows = bus.fan_out(event_envelopes(spark, sf_dir), SUBSCRIPTIONS).select("target")
    known = spark.createDataFrame([("stream", "archive"), ("queue", "orders"), ("queue", "other")], "kind string, name string")
    return bus.executed(rows, known).groupBy("status").agg(F.count("*").alias("routes"))


_ARCHIVE = f"WITH {ENVELOPES}, arc AS (SELECT *, row_number() OVER (ORDER BY time_ms, event_id) AS position FROM env)"


@query(_ARCHIVE + " SELECT position, event_id, type FROM arc WHERE time_ms BETWEEN 1704500000000 AND 1705500000000 AND ends_with(type, 'e') ORDER BY position LIMIT 500")
def archive_replay(spark, sf_dir):
    """Archived events of a time and type, in position order."""
    archive = stream.commit_positions(event_envelopes(spark, sf_dir)).withColumnRenamed("commit_position", "position")
    return bus.replay(archive, 1_704_500_000_000, 1_705_500_000_000, bus.EventFilter(types=("*e",)), 500).select("position", "event_id", "type")


@query(f"""WITH {ENVELOPES}, ch AS (SELECT v AS version, 1704067200000 + v * 259200000 AS at_ms FROM range(1, 8) t(v)),
sp AS (SELECT version, at_ms, lead(at_ms) OVER (ORDER BY version) AS until FROM ch)
SELECT coalesce(version, 0) AS version, count(*) AS events FROM env LEFT JOIN sp ON time_ms >= at_ms AND (until IS NULL OR time_ms < until) GROUP BY 1""")
def route_plan_as_of(spark, sf_dir):
    """Events by the version of the route plan in force."""
    changes = spark.range(1, 8).select(F.col("id").alias("version"), (1_704_067_200_000 + F.col("id") * 259_200_000).alias("at_ms"))
    return bus.plan_in_force(event_envelopes(spark, sf_dir), changes).groupBy("version").agg(F.count("*").alias("events"))


@query("""WITH m AS (SELECT event_id, event_type || '.' || (user_id % 4) AS channel FROM events),
s AS (SELECT 'exact' AS subscriber, event_id FROM m WHERE channel IN ('click.1', 'view.2') UNION ALL SELECT 'mixed', event_id FROM m WHERE channel = 'error.0' OR regexp_full_match(channel, '(?s)view\\..') UNION ALL SELECT 'wide', event_id FROM m WHERE contains(channel, 'i')),
r AS (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY event_id) AS n FROM s)
SELECT subscriber, least(count(*), 1024) AS pending, greatest(count(*) - 1024, 0) AS dropped, max(event_id) FILTER (n <= 1024) AS last_order FROM r GROUP BY 1""")
def pubsub_fanout(spark, sf_dir):
    """Waiting and dropped messages of channel subscribers."""
    messages = event_envelopes(spark, sf_dir).select("event_id", F.concat_ws(".", "type", (F.col("user_id") % 4).cast("string")).alias("channel"))
    subscribers = {"exact": (["click.1", "view.2"], []), "mixed": (["error.0"], ["view.?"]), "wide": ([], ["*i*"])}
    return bus.channel_fan_out(messages, subscribers, "event_id")


def deliveries(spark, sf_dir):
    """Events as deliveries in all states."""
    e = event_envelopes(spark, sf_dir)
    state = F.when(F.col("event_id") % 10 < 4, "pending").when(F.col("event_id") % 10 < 5, "in_flight").when(F.col("event_id") % 10 < 9, "acknowledged").otherwise("dead_lettered")
    return e.select(
        F.col("event_id").alias("publish_position"), F.col("type").alias("subscription"), state.alias("state"), (F.col("time_ms") + F.col("event_id") % 100_000).alias("eligible_at_ms"),
        F.concat_ws(".", F.lit("delivery.v1"), F.col("event_id").cast("string"), "type").alias("delivery_id"), (1 + F.col("event_id") % 9).cast("int").alias("attempt"),
    )


_DELIVERIES = f"""WITH {ENVELOPES}, del AS (SELECT event_id AS publish_position, type AS subscription, CASE WHEN event_id % 10 < 4 THEN 'pending' WHEN event_id % 10 < 5 THEN 'in_flight' WHEN event_id % 10 < 9 THEN 'acknowledged' ELSE 'dead_lettered' END AS state,
time_ms + event_id % 100000 AS eligible_at_ms, 'delivery.v1.' || event_id || '.' || type AS delivery_id, 1 + event_id % 9 AS attempt FROM env)"""


@query(_DELIVERIES + " SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'in_flight') AS in_flight, count(*) FILTER (state = 'acknowledged') AS acknowledged, count(*) FILTER (state = 'dead_lettered') AS dead_lettered FROM del")
def delivery_counts(spark, sf_dir):
    """Deliveries in each state."""
    return bus.counts(deliveries(spark, sf_dir))


@query(_DELIVERIES + " SELECT publish_position, subscription, delivery_id FROM del WHERE state = 'dead_lettered' AND subscription = 'view' ORDER BY publish_position, subscription LIMIT 100")
def delivery_query(spark, sf_dir):
    """The first dead-lettered deliveries of a subscription."""
    rows = deliveries(spark, sf_dir).filter("state = 'dead_lettered' AND subscription = 'view'")
    return rows.select("publish_position", "subscription", "delivery_id").orderBy("publish_position", "subscription").limit(100)


@query(_DELIVERIES + """, busy AS (SELECT subscription, count(*) AS b FROM del WHERE state = 'in_flight' GROUP BY 1),
due AS (SELECT *, row_number() OVER (PARTITION BY subscription ORDER BY publish_position, delivery_id) AS place FROM del WHERE state = 'pending' AND eligible_at_ms <= 1706000000000)
SELECT delivery_id, place FROM due LEFT JOIN busy USING (subscription) WHERE place <= 300 - coalesce(b, 0)""")
def delivery_candidates(spark, sf_dir):
    """Deliveries that may start now within each subscription's window."""
    return bus.candidates(deliveries(spark, sf_dir), 1_706_000_000_000, 300).select("delivery_id", F.col("place").cast("bigint").alias("place"))


@query(_DELIVERIES + f""", b AS (SELECT *, least(1000 * (1::BIGINT << least(attempt - 1, 7)), 60000) AS base FROM del),
h AS (SELECT *, sha256(encode('{retry.DELIVERY_DOMAIN}') || '\\x00'::BLOB || unhex(lpad(hex(strlen(delivery_id)::BIGINT), 16, '0')) || encode(delivery_id) || unhex(lpad(hex(attempt::BIGINT), 8, '0'))) AS d FROM b)
SELECT delivery_id, (base - base * 10 // 100 + (('0x' || d[1:16])::UBIGINT % (2 * (base * 10 // 100) + 1))::BIGINT)::BIGINT AS delay_ms FROM h""")
def delivery_backoff(spark, sf_dir):
    """Delays of deliveries with jitter from their digests."""
    policy = retry.RetryPolicy()
    return deliveries(spark, sf_dir).select("delivery_id", retry.delivery_delay(F.col("delivery_id"), F.col("attempt"), policy).alias("delay_ms"))


@query(f"WITH {ENVELOPES} SELECT event_id FROM env WHERE regexp_full_match(type || '.' || key, '(?s)[a-z]*\\.1.') OR ends_with(type || '.' || key, '.7')")
def glob_filter(spark, sf_dir):
    """Events whose name matches one of two globs."""
    name = F.concat_ws(".", "type", "key")
    return event_envelopes(spark, sf_dir).filter(matching.any_glob(name, ["*.1?", "*.7"])).select("event_id")
