"""Queries over point reads, registries, typed values and settlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystream.functions import matching, webhook
from tallystream.operators import bus, cache, inventory, queue, search, stream
from tallystream.plans.bus_queries import _DELIVERIES, deliveries
from tallystream.plans.registry import ENVELOPES, RECORDS, query
from tallystream.plans.state_queries import _ENTRIES, _MESSAGES, entries, messages
from tallystream.plans.stream_queries import _AGE, DAY, NOW, records
from tallystream.sources.envelopes import event_envelopes, table

# --- point reads -----------------------------------------------------------------


@query(f"WITH {_ENTRIES} SELECT key, value, last_access_revision, expires_at_ms FROM en WHERE key = '7' AND (expires_at_ms IS NULL OR expires_at_ms > 1704100000000)")
def cache_get(spark, sf_dir):
    """The live entry of a key."""
    return cache.get(entries(spark, sf_dir), "7", 1_704_100_000_000).select("key", "value", "last_access_revision", "expires_at_ms")


@query(f"WITH {_ENTRIES} SELECT key, value, storage_class FROM en WHERE storage_class = 'cold'")
def cache_class_items(spark, sf_dir):
    """All entries of a storage class."""
    return cache.of_class(entries(spark, sf_dir), "cold").select("key", "value", "storage_class")


@query(f"WITH {_MESSAGES} SELECT id, state, priority, commit_position FROM ms WHERE id = '36'")
def queue_message(spark, sf_dir):
    """A message by its id."""
    return queue.message(messages(spark, sf_dir), "36").select("id", "state", "priority", "commit_position")


@query(f"WITH {_MESSAGES}, d AS (SELECT min(commit_position)::VARCHAR AS id FROM ms WHERE state = 'dead_lettered') SELECT id, dead_at_ms FROM ms JOIN d USING (id)")
def dead_letter_lookup(spark, sf_dir):
    """The letter of the first message that is dead."""
    rows = messages(spark, sf_dir)
    first = rows.filter("state = 'dead_lettered'").agg(F.min("commit_position").cast("string")).first()[0]
    return queue.dead_letter(rows, rows.select("id", "dead_at_ms"), str(first))


@query(f"WITH {_MESSAGES} SELECT id, dead_at_ms FROM ms WHERE state = 'dead_lettered' AND commit_position % 3 <> 0 ORDER BY dead_at_ms, id LIMIT 200")
def pending_forwards(spark, sf_dir):
    """Dead letters that wait to be forwarded."""
    letters = messages(spark, sf_dir).filter("state = 'dead_lettered'")
    return queue.pending_forwards(letters, letters.filter("commit_position % 3 = 0").select("id"), 200).select("id", "dead_at_ms")


@query(_DELIVERIES + " SELECT delivery_id, state, attempt::INTEGER AS attempt FROM del WHERE delivery_id LIKE 'delivery.v1.77.%'")
def delivery_by_id(spark, sf_dir):
    """A delivery by its id."""
    rows = deliveries(spark, sf_dir)
    wanted = rows.filter("publish_position = 77").first()["delivery_id"]
    return bus.delivery(rows, wanted).select("delivery_id", "state", "attempt")


_CATALOG = "cat AS (SELECT s_suppkey, 'o' || (s_suppkey % 3) AS organization, 'n' || s_nationkey AS project, 'prod' AS environment, 'default' AS namespace, 'stream' AS kind, s_name AS name, shard, 't' || (s_suppkey * 4 + shard) AS tablet FROM supplier, range(4) r(shard))"


@query(f"WITH {_CATALOG} SELECT tablet FROM cat WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier) AND shard = 2")
def catalog_route(spark, sf_dir):
    """The tablet of a shard of a resource."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    catalog = s.select(
        F.concat(F.lit("o"), (k % 3).cast("string")).alias("organization"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("project"), F.lit("prod").alias("environment"),
        F.lit("default").alias("namespace"), F.lit("stream").alias("kind"), F.col("s_name").alias("name"), k.alias("s_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shard"),
    )
    catalog = catalog.withColumn("tablet", F.concat(F.lit("t"), (F.col("s_suppkey") * 4 + F.col("shard")).cast("string")))
    first = catalog.orderBy("s_suppkey").first()
    return inventory.route(catalog, {part: first[part] for part in inventory.NAME_PARTS}, 2).select("tablet")


@query("SELECT event_id // 50 AS version, event_id % 50 AS seq, event_type AS command FROM events WHERE event_id // 50 >= 3 ORDER BY 1, 2 LIMIT 120")
def journal_scan(spark, sf_dir):
    """Commands of a log from a version on."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.floor(F.col("event_id") / 50).alias("version"), (F.col("event_id") % 50).alias("seq"), F.col("event_type").alias("command"))
    return cache.journal(log, 3, 120)


# --- registries, settlements and offsets -----------------------------------------


@query("""WITH c AS (SELECT 'sub-' || (user_id % 30) AS name, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type || '.*' END AS filter FROM events)
SELECT name, arg_max(coalesce(filter, ''), seq) AS filter, count(filter) AS upserts FROM c GROUP BY 1 HAVING arg_max(coalesce(filter, ''), seq) <> ''""")
def subscriptions_after(spark, sf_dir):
    """Subscriptions after upserts and removals."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "error", F.concat(F.col("event_type"), F.lit(".*")))
    return bus.subscriptions_after(e.select(F.concat(F.lit("sub-"), (F.col("user_id") % 30).cast("string")).alias("name"), F.col("event_id").alias("seq"), kind.alias("filter")))


@query(_DELIVERIES + " SELECT delivery_id, CASE WHEN attempt >= 6 THEN 'dead_lettered' ELSE 'pending' END AS state_after FROM del WHERE state = 'in_flight' AND eligible_at_ms + 30000 <= 1705000000000 ORDER BY eligible_at_ms + 30000, delivery_id LIMIT 250")
def delivery_lease_sweep(spark, sf_dir):
    """Deliveries whose lease is over."""
    rows = deliveries(spark, sf_dir).withColumn("lease_until_ms", F.col("eligible_at_ms") + 30_000)
    return bus.lease_sweep(rows, 1_705_000_000_000, 6, 250).select("delivery_id", "state_after")


@query("""WITH c AS (SELECT user_id % 16 AS grp, user_id % 9 AS partition, event_id AS seq, event_type = 'error' AS reset, event_id % 1000 AS o, 10 * (user_id % 9) AS base, 800 + 20 * (user_id % 9) AS stop FROM events),
i AS (SELECT *, partition < 8 AND o BETWEEN base AND stop AS inside FROM c),
s AS (SELECT *, sum((reset AND inside)::INTEGER) OVER (PARTITION BY grp, partition ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM i),
b AS (SELECT *, max(CASE WHEN inside THEN o END) OVER (PARTITION BY grp, partition, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT grp AS "group", count(*) AS commands, count(*) FILTER (inside AND (reset OR o >= coalesce(before, base))) AS accepted FROM b GROUP BY 1""")
def offset_commits(spark, sf_dir):
    """Offsets of consumer groups that are committed and reset, without a fold: the commands of ``offset_fold``."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "reset").otherwise("commit")
    rows = e.select((F.col("user_id") % 16).alias("group"), (F.col("user_id") % 9).alias("partition"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 1_000).alias("offset"))
    limits = spark.range(8).select(F.col("id").alias("partition"), (10 * F.col("id")).alias("base_offset"), (800 + 20 * F.col("id")).alias("end_offset"))
    return stream.commits(rows, limits).groupBy("group").agg(F.count("*").alias("commands"), F.count_if("accepted").alias("accepted"))


@query(f"""WITH {RECORDS}, t AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS n FROM rec) SELECT event_id, partition, "offset" FROM t WHERE n <= 400 AND {_AGE}""")
def retention_configure(spark, sf_dir):
    """What is kept after retention by count and then, in its place, by age."""
    marked = stream.reconfigured(records(spark, sf_dir), [stream.Retention(max_records=400), stream.Retention(max_age_ms=12 * DAY)], NOW)
    return marked.filter("kept").select("event_id", "partition", "offset")


# --- typed values and scalars ----------------------------------------------------


@query("""SELECT event_id, '{"k":' || (props::JSON->>'k') || ',"z":{"y":1}}' AS edited FROM events""")
def json_pointer_set(spark, sf_dir):
    """Events' properties with a value set at a pointer, as canonical JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    return search.edited(rows, "set", "/z/y", "1").select("event_id", "edited")


@query("""SELECT event_id, '{}' AS edited FROM events""")
def json_pointer_remove(spark, sf_dir):
    """Events' properties without the field at a pointer."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    return search.edited(rows, "remove", "/k").select("event_id", "edited")


@query("""WITH d AS (SELECT event_id, repeat('[', (event_id % 80)::INTEGER) || '1' || repeat(']', (event_id % 80)::INTEGER) AS v FROM events)
SELECT event_id, CASE WHEN event_id % 80 + 2 <= 64 THEN '{"a":' || v || ',"b":0}' END AS edited FROM d""")
def json_depth_bound(spark, sf_dir):
    """Nested documents, of which those that are too deep are refused."""
    depth = (F.col("event_id") % 80).cast("int")
    nested = F.concat(F.repeat(F.lit("["), depth), F.lit("1"), F.repeat(F.lit("]"), depth))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a": '), nested, F.lit("}")).alias("payload"))
    return search.edited(rows, "set", "/b", "0").select("event_id", "edited")


@query("""WITH n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type || '.' || user_id WHEN 2 THEN 'has space' WHEN 3 THEN '' WHEN 4 THEN repeat('x', 120 + (event_id % 20)::INTEGER) ELSE 'é' || user_id END AS name FROM events)
SELECT event_id, regexp_full_match(name, '[A-Za-z0-9._-]{1,128}') AS name_ok, trim(name) <> '' AND strlen(name) <= 130 AS identifier_ok FROM n""")
def name_validation(spark, sf_dir):
    """Which names and identifiers are valid."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 6
    name = (
        F.when(k == 0, F.col("event_type")).when(k == 1, F.concat_ws(".", "event_type", F.col("user_id").cast("string"))).when(k == 2, "has space").when(k == 3, "")
        .when(k == 4, F.repeat(F.lit("x"), (120 + F.col("event_id") % 20).cast("int"))).otherwise(F.concat(F.lit("é"), F.col("user_id").cast("string")))
    )
    return e.select("event_id", matching.valid_name(name).alias("name_ok"), matching.valid_identifier(name, 130).alias("identifier_ok"))


@query(f"WITH {ENVELOPES} SELECT event_id, time_ms + CASE WHEN event_id % 3 = 0 THEN event_id + 1 ELSE 60000 END AS expires_at_ms FROM env")
def ttl_deadline(spark, sf_dir):
    """When entries written at events' times expire, by their own time to live or the default one."""
    ttl = F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1)
    return event_envelopes(spark, sf_dir).select("event_id", cache.deadline(F.col("time_ms"), ttl, 60_000).alias("expires_at_ms"))


_SECRET = b"a secret of these queries"
_PADS = [bytes(b ^ pad for b in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""WITH {ENVELOPES}, t AS (SELECT event_id, encode('v1' || chr(10) || time_ms // 1000 || chr(10) || 'd' || event_id || chr(10) || (1 + event_id % 4) || chr(10) || sha256(coalesce(payload, ''))) AS text FROM env)
SELECT event_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || text))) AS signature FROM t""")
def webhook_signature(spark, sf_dir):
    """Signatures of webhook requests."""
    e = event_envelopes(spark, sf_dir)
    signed = webhook.signature(_SECRET, F.floor(F.col("time_ms") / 1_000), F.concat(F.lit("d"), F.col("event_id").cast("string")), 1 + F.col("event_id") % 4, F.coalesce("payload", F.lit("")))
    return e.select("event_id", signed.alias("signature"))


@query("SELECT event_id, CASE WHEN event_id % 600 BETWEEN 200 AND 299 THEN 'acknowledge' WHEN event_id % 600 = 429 OR event_id % 600 BETWEEN 500 AND 599 THEN 'retry' ELSE 'reject' END AS outcome FROM events")
def webhook_disposition(spark, sf_dir):
    """What becomes of deliveries by the status of the answer."""
    return table(spark, sf_dir, "events").select("event_id", webhook.disposition(F.col("event_id") % 600).alias("outcome"))
