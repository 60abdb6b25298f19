"""Queries over keyed state, work queues, searches, sketches and resources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallystream.functions import hashes, matching, retry, sketches
from tallystream.operators import cache, inventory, queue, search
from tallystream.plans.registry import ENVELOPES, query
from tallystream.sources.envelopes import event_envelopes, table, unix_ms

NOW = 1_706_000_000_000

# --- keyed state ---------------------------------------------------------------


def changes(spark, sf_dir):
    """Events as sets and deletes (on errors) of their user's entry; the revision is the event's id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("revision"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))


_CHANGES = "ch AS (SELECT user_id::VARCHAR AS key, event_id AS revision, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events)"
_IMAGES = _CHANGES + ", im AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY revision) AS before FROM ch), img AS (SELECT * FROM im WHERE before IS DISTINCT FROM value)"


@query(f"WITH {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS n, count(*) OVER (PARTITION BY key) AS versions FROM ch) SELECT key, value, revision, versions FROM l WHERE n = 1 AND value IS NOT NULL")
def cache_lww(spark, sf_dir):
    """Live entries after all changes."""
    return cache.last_writes(changes(spark, sf_dir))


@query(f"WITH {_IMAGES} SELECT key, revision, before, value FROM img WHERE revision >= 500 ORDER BY revision LIMIT 1024")
def cache_changes(spark, sf_dir):
    """The change feed from a revision on."""
    return cache.change_images(changes(spark, sf_dir)).filter("revision >= 500").orderBy("revision").limit(1024)


@query(f"WITH {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS n FROM ch WHERE revision <= 4000) SELECT key, value FROM l WHERE n = 1 AND value IS NOT NULL")
def cache_at_revision(spark, sf_dir):
    """The entries at an earlier revision, from the current ones and the changes."""
    rows = changes(spark, sf_dir)
    return cache.at_revision(cache.last_writes(rows), cache.change_images(rows), 4_000)


@query(f"""WITH {_CHANGES}, a AS (SELECT key, arg_max(coalesce(value, ''), revision) AS v FROM ch WHERE revision <= 4000 GROUP BY 1), b AS (SELECT key, arg_max(coalesce(value, ''), revision) AS v FROM ch GROUP BY 1),
d AS (SELECT key, nullif(a.v, '') AS before, nullif(b.v, '') AS after FROM a FULL OUTER JOIN b USING (key))
SELECT key, before, after, CASE WHEN before IS NULL THEN 'created' WHEN after IS NULL THEN 'deleted' ELSE 'updated' END AS kind FROM d WHERE before IS DISTINCT FROM after""")
def cdc_diff(spark, sf_dir):
    """What changed between two revisions."""
    rows = changes(spark, sf_dir)
    return cache.difference(cache.last_writes(rows.filter("revision <= 4000")), cache.last_writes(rows))


def entries(spark, sf_dir):
    """Users as entries, with how often and when they were last seen."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("event_id").alias("last_access_revision"), F.count("*").alias("access_count"), F.max_by("event_type", "event_id").alias("value"), F.max(unix_ms(F.col("ts"))).alias("seen_ms"))
    uid = F.col("key").cast("bigint")
    return rows.select("*", F.when(uid % 3 != 0, F.col("seen_ms") + uid % 7 * 1_000_000).alias("expires_at_ms"), F.when(uid % 2 == 0, "memory").otherwise("cold").alias("storage_class"))


_ENTRIES = """en AS (SELECT *, CASE WHEN key::BIGINT % 3 <> 0 THEN seen_ms + key::BIGINT % 7 * 1000000 END AS expires_at_ms, CASE WHEN key::BIGINT % 2 = 0 THEN 'memory' ELSE 'cold' END AS storage_class
FROM (SELECT user_id::VARCHAR AS key, max(event_id) AS last_access_revision, count(*) AS access_count, arg_max(event_type, event_id) AS value, max(date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000) AS seen_ms FROM events GROUP BY 1))"""


def _evicted(name, policy, order, where="true"):
    def run(spark, sf_dir):
        return cache.victims(entries(spark, sf_dir), policy, 40, 77).select("key", "last_access_revision", "access_count")

    run.__name__ = name
    run.__doc__ = f"The entries that {policy} evicts first."
    query(f"WITH {_ENTRIES} SELECT key, last_access_revision, access_count FROM en WHERE {where} ORDER BY {order}, key LIMIT 40")(run)


_evicted("eviction_lru", "all_keys_lru", "last_access_revision")
_evicted("eviction_lfu", "volatile_lfu", "access_count, last_access_revision", "expires_at_ms IS NOT NULL")
_evicted("eviction_ttl", "volatile_ttl", "expires_at_ms", "expires_at_ms IS NOT NULL")
_evicted("eviction_random", "all_keys_random", "sha256(encode('tallystream/eviction-rank/v1') || '\\x00'::BLOB || unhex('000000000000004D') || encode(key))")


@query(f"WITH {_ENTRIES} SELECT storage_class, count(*) AS entries, sum(strlen(key) + strlen(value) + 40)::BIGINT AS bytes FROM en GROUP BY 1")
def storage_class_bytes(spark, sf_dir):
    """Entries and bytes of each storage class."""
    return cache.class_bytes(entries(spark, sf_dir))


@query(f"""WITH {_ENTRIES}, s AS (SELECT *, strlen(key) + strlen(value) + 40 AS size, sum(strlen(key) + strlen(value) + 40) OVER (PARTITION BY storage_class) AS total, sum(strlen(key) + strlen(value) + 40) OVER (PARTITION BY storage_class ORDER BY last_access_revision, key ROWS UNBOUNDED PRECEDING) AS gone FROM en)
SELECT key, storage_class FROM s WHERE total - (gone - size) > CASE storage_class WHEN 'memory' THEN 2000 ELSE 1500 END""")
def eviction_bytes(spark, sf_dir):
    """Entries that leave so that each class keeps to its bytes."""
    return cache.byte_victims(entries(spark, sf_dir), ["last_access_revision"], {"memory": 2_000, "cold": 1_500}).select("key", "storage_class")


@query(f"WITH {_ENTRIES} SELECT key, expires_at_ms FROM en WHERE expires_at_ms <= 1706575000000 ORDER BY 2, 1 LIMIT 1000")
def expiry_sweep(spark, sf_dir):
    """Expired entries by deadline."""
    return cache.expired(entries(spark, sf_dir), 1_706_575_000_000).select("key", "expires_at_ms")


@query(f"WITH {_ENTRIES} SELECT count(*) AS live, min(expires_at_ms) AS next_deadline_ms FROM en WHERE expires_at_ms IS NULL OR expires_at_ms > 1706500000000")
def cache_observe(spark, sf_dir):
    """Live entries and the next deadline."""
    return cache.live(entries(spark, sf_dir), 1_706_500_000_000).agg(F.count("*").alias("live"), F.min("expires_at_ms").alias("next_deadline_ms"))


@query("SELECT user_id::VARCHAR AS key, sum(CASE WHEN event_type = 'error' THEN -1 ELSE event_id END)::BIGINT AS counter FROM events GROUP BY 1")
def counter_increment(spark, sf_dir):
    """Counters after all increments."""
    e = table(spark, sf_dir, "events")
    return cache.counters(e.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("event_id")).alias("delta")))


@query("""WITH l AS (SELECT user_id::VARCHAR AS key, event_type AS field, arg_max(CASE WHEN event_id % 9 = 0 THEN '' ELSE props END, event_id) AS value FROM events GROUP BY 1, 2)
SELECT key, string_agg(field || '=' || value, ';' ORDER BY field) AS fields FROM l WHERE value <> '' GROUP BY 1""")
def hash_fields(spark, sf_dir):
    """Fields of each key's map after puts and removals."""
    e = table(spark, sf_dir, "events")
    puts = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 != 0, F.col("props")).alias("value"))
    return cache.hash_fields(puts).select("key", F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["field"], x["value"])), ";").alias("fields"))


@query("SELECT p_brand AS key, p_type AS member, arg_max(p_retailprice, p_partkey) AS score FROM part GROUP BY 1, 2")
def sorted_set(spark, sf_dir):
    """Members of sorted sets with their last score."""
    p = table(spark, sf_dir, "part")
    return cache.sorted_sets(p.select(F.col("p_brand").alias("key"), F.col("p_type").alias("member"), F.col("p_partkey").alias("seq"), F.col("p_retailprice").alias("score")))


@query("SELECT key, member FROM (SELECT event_type AS key, user_id::VARCHAR AS member, arg_max(event_id % 5 <> 0, event_id) AS added FROM events GROUP BY 1, 2) WHERE added")
def set_members(spark, sf_dir):
    """Members of sets after additions and removals."""
    e = table(spark, sf_dir, "events")
    return cache.sets_after(e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 != 0).alias("added")))


@query("""WITH f AS (SELECT user_id || ':' || event_type AS k, min(event_id) AS seq FROM events GROUP BY 1)
SELECT k AS idempotency_key, seq, ('0x' || sha256(encode('tallystream/proposal/v1') || '\\x00'::BLOB || unhex(lpad(hex(strlen(k)::BIGINT), 16, '0')) || encode(k))[1:16])::UBIGINT::DECIMAL(20,0) AS proposal_id FROM f""")
def command_replay(spark, sf_dir):
    """The first command of each idempotency key and its number."""
    e = table(spark, sf_dir, "events")
    return cache.proposals(e.select(F.concat_ws(":", "user_id", "event_type").alias("idempotency_key"), F.col("event_id").alias("seq")), "tallystream/proposal/v1")


# --- work queues ---------------------------------------------------------------


def messages(spark, sf_dir):
    """Orders as queue messages in all states."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "acknowledged").when(k % 6 == 0, "leased").when(k % 6 == 1, "scheduled").when(k % 13 == 0, "dead_lettered").when(k % 17 == 0, "expired").otherwise("ready")
    return o.select(
        k.cast("string").alias("id"), k.alias("commit_position"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), state.alias("state"), unix_ms(F.col("o_orderdate")).alias("enqueued_at_ms"),
        F.octet_length("o_orderpriority").cast("bigint").alias("bytes"), F.concat(F.lit("c"), (F.col("o_custkey") % 11).cast("string")).alias("consumer"), (k % 4).alias("consumer_term"),
        F.when(k % 5 == 0, F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string"))).alias("session_id"), F.when(k % 4 == 0, F.concat(F.lit("k"), (F.col("o_custkey") % 9).cast("string"))).alias("correlation_id"),
        (unix_ms(F.col("o_orderdate")) + k % 1000).alias("eligible_at_ms"), (unix_ms(F.col("o_orderdate")) + k % 3000).alias("deadline_ms"), F.when(k % 3 == 0, k % 5000 + 10).alias("ttl_ms"),
        (unix_ms(F.col("o_orderdate")) + 5).alias("dead_at_ms"), (1 + k % 8).cast("int").alias("attempt"),
    )


_MESSAGES = """ms AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey AS commit_position, o_orderpriority[1]::INTEGER AS priority, date_diff('microsecond', TIMESTAMP '1970-01-01', o_orderdate::TIMESTAMP) // 1000 AS enqueued_at_ms, strlen(o_orderpriority) AS bytes, 'c' || (o_custkey % 11) AS consumer, o_orderkey % 4 AS consumer_term,
CASE WHEN o_orderstatus = 'F' THEN 'acknowledged' WHEN o_orderkey % 6 = 0 THEN 'leased' WHEN o_orderkey % 6 = 1 THEN 'scheduled' WHEN o_orderkey % 13 = 0 THEN 'dead_lettered' WHEN o_orderkey % 17 = 0 THEN 'expired' ELSE 'ready' END AS state,
CASE WHEN o_orderkey % 5 = 0 THEN 's' || (o_custkey % 20) END AS session_id, CASE WHEN o_orderkey % 4 = 0 THEN 'k' || (o_custkey % 9) END AS correlation_id, date_diff('microsecond', TIMESTAMP '1970-01-01', o_orderdate::TIMESTAMP) // 1000 + o_orderkey % 1000 AS eligible_at_ms, date_diff('microsecond', TIMESTAMP '1970-01-01', o_orderdate::TIMESTAMP) // 1000 + o_orderkey % 3000 AS deadline_ms,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5000 + 10 END AS ttl_ms, date_diff('microsecond', TIMESTAMP '1970-01-01', o_orderdate::TIMESTAMP) // 1000 + 5 AS dead_at_ms, (1 + o_orderkey % 8)::INTEGER AS attempt FROM orders)"""
_ACTIVE = "state IN ('ready', 'scheduled', 'leased')"


@query(f"WITH {_MESSAGES} SELECT id, priority, commit_position FROM ms WHERE state = 'ready' ORDER BY priority DESC, commit_position LIMIT 200")
def queue_ready_order(spark, sf_dir):
    """The next ready messages."""
    return queue.ready_order(messages(spark, sf_dir), 200).select("id", "priority", "commit_position")


@query(f"WITH {_MESSAGES} SELECT id, least(priority + greatest(1000000000000 - enqueued_at_ms, 0) // 86400000, 255)::BIGINT AS effective FROM ms WHERE state = 'ready' AND session_id IS NULL AND commit_position % 10 <> 3 ORDER BY effective DESC, commit_position, id LIMIT 300")
def aged_priority_order(spark, sf_dir):
    """The next ready messages, with priorities raised by waiting, without sessions and deferred ones."""
    rows = messages(spark, sf_dir)
    deferred = rows.filter("commit_position % 10 = 3").select("id")
    return queue.aged_order(rows, 1_000_000_000_000, 86_400_000, 300, deferred).select("id", "effective")


@query(f"WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY commit_position, id) AS place FROM ms WHERE state = 'ready' AND session_id IS NOT NULL) SELECT session_id, id, place FROM r WHERE place <= 3")
def session_fifo(spark, sf_dir):
    """The first messages of each session."""
    return queue.session_heads(messages(spark, sf_dir), 3).select("session_id", "id", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {_MESSAGES} SELECT {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in queue.STATES)}, count(*) FILTER ({_ACTIVE}) AS active, coalesce(sum(bytes) FILTER ({_ACTIVE}), 0)::BIGINT AS active_bytes FROM ms""")
def queue_state_counts(spark, sf_dir):
    """Messages in each state."""
    return queue.state_counts(messages(spark, sf_dir))


@query(f"WITH {_MESSAGES} SELECT consumer, count(*) AS in_flight, max(consumer_term) AS term FROM ms WHERE state = 'leased' GROUP BY 1")
def in_flight_by_consumer(spark, sf_dir):
    """Leased messages of each consumer."""
    return queue.consumer_flow(messages(spark, sf_dir))


@query(f"WITH {_MESSAGES} SELECT min(least(CASE WHEN state = 'scheduled' THEN eligible_at_ms END, CASE WHEN state = 'leased' THEN deadline_ms END, enqueued_at_ms + ttl_ms, enqueued_at_ms + 9000)) AS next_deadline_ms FROM ms WHERE {_ACTIVE}")
def queue_deadline(spark, sf_dir):
    """When the queue has to be maintained next."""
    return queue.next_deadline(messages(spark, sf_dir), 9_000)


@query(f"WITH {_MESSAGES} SELECT id, commit_position FROM ms WHERE {_ACTIVE} AND correlation_id = 'k4' ORDER BY commit_position, id")
def correlation_lookup(spark, sf_dir):
    """Active messages of a correlation."""
    return queue.correlated(messages(spark, sf_dir), "k4").select("id", "commit_position")


@query(f"WITH {_MESSAGES} SELECT id, dead_at_ms FROM ms WHERE state = 'dead_lettered' ORDER BY dead_at_ms, id LIMIT 100")
def dead_letter_list(spark, sf_dir):
    """The first dead letters."""
    return queue.dead_letters(messages(spark, sf_dir), 100).select("id", "dead_at_ms")


@query(f"""WITH {_MESSAGES}, h AS (SELECT id, dead_at_ms FROM ms WHERE commit_position % 13 = 0 AND commit_position % 2 = 0), l AS (SELECT id, dead_at_ms FROM ms WHERE state = 'dead_lettered')
SELECT id, dead_at_ms, id IN (SELECT id FROM l) AS current, false AS fresh FROM h UNION ALL SELECT id, dead_at_ms, true, true FROM l WHERE id NOT IN (SELECT id FROM h)""")
def dead_letter_reconcile(spark, sf_dir):
    """Dead-letter history against the letters of now."""
    rows = messages(spark, sf_dir)
    history = rows.filter("commit_position % 26 = 0").select("id", "dead_at_ms")
    return queue.reconciled_letters(history, rows.filter("state = 'dead_lettered'").select("id", "dead_at_ms"))


@query(f"""WITH {_MESSAGES}, h AS (SELECT id, attempt, least(1000 * (1::BIGINT << (attempt - 1)), 60000) AS base, list_reduce(list_prepend(0::UHUGEINT, list_transform(string_split(id, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (h * 31 + b) % 18446744073709551616::UHUGEINT) AS hash FROM ms)
SELECT id, attempt, base AS plain_ms, (base - base * 10 // 100 + (hash % (2 * (base * 10 // 100) + 1)::UHUGEINT)::BIGINT)::BIGINT AS delay_ms FROM h""")
def retry_schedule(spark, sf_dir):
    """Delays of messages with and without jitter."""
    rows, plain = messages(spark, sf_dir), retry.RetryPolicy(jitter_percent=0)
    return rows.select("id", "attempt", retry.message_delay(F.col("id"), F.col("attempt"), plain).alias("plain_ms"), retry.message_delay(F.col("id"), F.col("attempt"), retry.RetryPolicy()).alias("delay_ms"))


# --- searches and sketches -----------------------------------------------------


def _probe(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 7").first()["embedding"]]


_COSINE = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7),
cs AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, q)"""


@query(f"WITH {_COSINE} SELECT id, round(c, 6) AS score FROM cs ORDER BY score DESC, id LIMIT 20")
def vector_topk(spark, sf_dir):
    """The vectors nearest to one of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.vector_search(rows, _probe(spark, sf_dir), 20).select("id", "score")


@query(f"""WITH {_COSINE}, t AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS tok FROM documents),
j AS (SELECT id, len(list_intersect(tok, ['and', 'of', 'the'])) AS i, len(tok) + 3 - len(list_intersect(tok, ['and', 'of', 'the'])) AS u, len(tok) AS n FROM t)
SELECT id, round(c * 0.7 + CASE WHEN n = 0 THEN 0.0 ELSE i / u END * (1 - 0.7), 6) AS score FROM cs JOIN j USING (id) WHERE label < 5 ORDER BY score DESC, id LIMIT 20""")
def hybrid_topk(spark, sf_dir):
    """The best of some vectors by vector and text together."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label").join(d.select(F.col("doc_id").alias("id"), "text"), "id")
    return search.vector_search(rows, _probe(spark, sf_dir), 20, "The AND of, the!", 0.7, F.col("label") < 5).select("id", "score")


@query("""WITH t AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS tok FROM documents),
j AS (SELECT id, len(list_intersect(tok, ['de', 'la', 'que', 'los'])) AS i, len(tok) AS n FROM t)
SELECT id, round(i / (n + 4 - i), 6) AS score FROM j WHERE i > 0 ORDER BY score DESC, id LIMIT 50""")
def text_jaccard(spark, sf_dir):
    """The documents nearest to a text by their tokens."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.text_search(d, "de la que los", 50).select("id", "score")


@query("""WITH p AS (SELECT s_name AS member, round((88.0 + (s_suppkey * 37 % 1000) / 1000.0) * 1000000)::INTEGER AS lon, round((22.0 + (s_suppkey * 53 % 1000) / 1000.0) * 1000000)::INTEGER AS lat FROM supplier),
h AS (SELECT member, 2 * 6371000.0 * asin(sqrt(pow(sin((radians(lat / 1000000.0) - radians(22.5726)) / 2), 2) + cos(radians(lat / 1000000.0)) * cos(radians(22.5726)) * pow(sin((radians(lon / 1000000.0) - radians(88.3639)) / 2), 2))) AS m FROM p)
SELECT member, round(m, 3) AS meters FROM h WHERE m <= 40000 ORDER BY m, member LIMIT 100""")
def geo_radius(spark, sf_dir):
    """Suppliers around a place."""
    s = table(spark, sf_dir, "supplier")
    lon = 88.0 + (F.col("s_suppkey") * 37 % 1000) / 1000.0
    lat = 22.0 + (F.col("s_suppkey") * 53 % 1000) / 1000.0
    points = s.select(F.col("s_name").alias("member"), matching.micro_degrees(lon).alias("lon"), matching.micro_degrees(lat).alias("lat"))
    return search.geo_radius(points, 88.3639, 22.5726, 40_000, 100).select("member", "meters")


@query("SELECT event_id AS id FROM events WHERE json_extract(props, '$.k')::BIGINT = 42 ORDER BY 1 LIMIT 100")
def json_exact(spark, sf_dir):
    """Events with a value at a JSON path."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("payload"))
    return search.json_exact(e, "k", "42").select("id")


@query("SELECT '$.k' AS path, json_extract(props, '$.k')::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1, 2")
def json_index(spark, sf_dir):
    """How often each value stands at an indexed path."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("payload"))
    return search.postings(e, ["$.k", "$.missing"]).groupBy("path", "value").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id * 37 % 100000) AS bits_set FROM events GROUP BY 1")
def bitmap_count(spark, sf_dir):
    """Bits that users set in each type's bitmap."""
    e = table(spark, sf_dir, "events")
    return sketches.bitmap_counts(e, F.col("user_id") * 37 % 100_000, ["event_type"])


_HLL = """h AS (SELECT event_type, ('0x' || sha256(user_id::VARCHAR)[1:16])::UBIGINT AS h FROM events),
r AS (SELECT event_type, h % 1024 AS register, max(CASE WHEN h // 1024 = 0 THEN 55 ELSE 54 - floor(log2((h // 1024)::DOUBLE))::INTEGER END) AS rank FROM h GROUP BY 1, 2)"""


@query(f"""WITH {_HLL}, s AS (SELECT event_type, 1024 - count(*) AS zeros, sum(pow(2.0, -rank)) AS t FROM r GROUP BY 1),
e AS (SELECT event_type, zeros, (0.7213 / (1 + 1.079 / 1024)) * 1024 * 1024 / (t + zeros) AS raw FROM s)
SELECT event_type, round(CASE WHEN raw <= 2560 AND zeros > 0 THEN 1024 * ln(1024.0 / zeros) ELSE raw END)::BIGINT AS estimate FROM e""")
def hll_estimate(spark, sf_dir):
    """Estimated users of each type."""
    e = table(spark, sf_dir, "events")
    return sketches.estimate(sketches.registers(e, F.col("user_id").cast("string"), 10, ["event_type"]), 10, ["event_type"])


def _bloom_sql(value: str, n: int) -> str:
    digest = f"sha256({value})"
    first, second = f"('0x' || {digest}[1:16])::UBIGINT::UHUGEINT", f"(('0x' || {digest}[17:32])::UBIGINT | 1)::UHUGEINT"
    return f"(({first} + i::UHUGEINT * {second}) % 18446744073709551616::UHUGEINT % {n})::INTEGER"


@query(f"""WITH b AS (SELECT DISTINCT {_bloom_sql("user_id::VARCHAR", 4096)} AS bit FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), range(5) t(i)),
p AS (SELECT c_custkey, {_bloom_sql("c_custkey::VARCHAR", 4096)} AS bit FROM customer, range(5) t(i))
SELECT c_custkey, count(*) FILTER (bit IN (SELECT bit FROM b)) = 5 AS maybe FROM p GROUP BY 1""")
def bloom_membership(spark, sf_dir):
    """Customers that a filter over users with errors may hold."""
    users = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("u")).distinct()
    bloom = sketches.bloom_filter(users, F.col("u"), 4_096, 5)
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return sketches.bloom_contains(c, F.col("c_custkey").cast("string"), bloom, 4_096, 5)


@query("SELECT event_id, ('0x' || sha256(props)[1:16])::UBIGINT::DECIMAL(20,0) AS hash FROM events")
def stable_hash(spark, sf_dir):
    """A stable number for each event's properties."""
    return table(spark, sf_dir, "events").select("event_id", hashes.stable_hash(F.col("props")).alias("hash"))


# --- resources -----------------------------------------------------------------


def resources(spark, sf_dir):
    """Customers as resources of nations' organizations."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(
        F.col("n_name").alias("organization"), F.col("c_mktsegment").alias("project"), F.when(k % 2 == 0, "prod").otherwise("dev").alias("environment"), F.lit("core").alias("namespace"),
        F.when(k % 4 == 0, "stream").when(k % 4 == 1, "queue").when(k % 4 == 2, "cache").otherwise("event_bus").alias("kind"), F.col("c_name").alias("name"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("cost_center"), F.when(k % 5 != 0, F.when(k % 3 == 0, "restricted").otherwise("internal")).alias("classification"), (1 + k % 7).cast("int").alias("shards"),
        F.create_map(F.lit("tier"), F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tags"),
    )


_RESOURCES = """res AS (SELECT n_name AS organization, c_mktsegment AS project, CASE WHEN c_custkey % 2 = 0 THEN 'prod' ELSE 'dev' END AS environment, 'core' AS namespace, CASE c_custkey % 4 WHEN 0 THEN 'stream' WHEN 1 THEN 'queue' WHEN 2 THEN 'cache' ELSE 'event_bus' END AS kind, c_name AS name,
CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS cost_center, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'restricted' ELSE 'internal' END END AS classification, (1 + c_custkey % 7)::INTEGER AS shards, 't' || (c_custkey % 3) AS tier FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {_RESOURCES} SELECT organization, project, environment, namespace, kind, name FROM res WHERE environment = 'prod' AND kind = 'stream' AND tier = 't1'")
def resource_inventory(spark, sf_dir):
    """Resources of an environment, kind and tag."""
    return inventory.listed(resources(spark, sf_dir), {"environment": "prod", "kind": "stream"}, {"tier": "t1"}).select(*inventory.NAME_PARTS)


@query(f"WITH {_RESOURCES} SELECT coalesce(cost_center, 'unassigned') AS cost_center, coalesce(classification, 'unspecified') AS classification, count(*) AS resources, sum(shards)::BIGINT AS shards FROM res GROUP BY 1, 2")
def cost_attribution(spark, sf_dir):
    """Costs by center and classification."""
    return inventory.cost_attribution(resources(spark, sf_dir))


@query("SELECT kind, name, kind || ':' || name AS resource FROM (SELECT 'stream' AS kind, r_name AS name FROM region UNION ALL SELECT 'queue', n_name FROM nation UNION ALL SELECT 'cache', s_name FROM supplier)")
def engine_resources(spark, sf_dir):
    """Resources of all kinds."""
    parts = {"stream": ("region", "r_name"), "queue": ("nation", "n_name"), "cache": ("supplier", "s_name")}
    return inventory.engine_resources({k: table(spark, sf_dir, t).select(F.col(c).alias("name")) for k, (t, c) in parts.items()})


@query(f"WITH {_RESOURCES} SELECT count(*) AS resources, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, 'ok' AS status FROM res")
def engine_health(spark, sf_dir):
    """How many resources there are, and of which kinds."""
    return inventory.health(resources(spark, sf_dir))


@query("""WITH nodes AS (SELECT r_regionkey AS node, CASE WHEN r_regionkey < 4 THEN 'west' ELSE 'east' END AS region, 'z' || (r_regionkey % 3) AS zone, 'std' AS class, 10 + r_regionkey AS available FROM region),
req AS (SELECT n_name AS request, CASE n_nationkey % 4 WHEN 0 THEN 'west' END AS region, CASE n_nationkey % 3 WHEN 0 THEN 'std' WHEN 1 THEN CASE WHEN n_nationkey > 18 THEN 'big' END END AS class, 1 + n_nationkey % 4 AS min_zones, n_nationkey AS added FROM nation),
s AS (SELECT request, min_zones, added, bool_and(coalesce(req.region = nodes.region, true) AND coalesce(req.class = nodes.class, true)) AS eligible, count(DISTINCT zone) AS zones, min(available)::INTEGER AS room FROM req, nodes GROUP BY 1, 2, 3)
SELECT request, zones, room, CASE WHEN NOT eligible THEN 'fixed_voters_ineligible' WHEN zones < min_zones THEN 'insufficient_zones' WHEN added > 0 AND room < added THEN 'consensus_group_capacity' ELSE 'admitted' END AS decision FROM s""")
def placement_admission(spark, sf_dir):
    """Whether a cluster's nodes admit placements."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = r.select(F.when(F.col("r_regionkey") < 4, "west").otherwise("east").alias("node_region"), F.concat(F.lit("z"), (F.col("r_regionkey") % 3).cast("string")).alias("zone"), F.lit("std").alias("class"), (10 + F.col("r_regionkey")).alias("available"))
    k = F.col("n_nationkey")
    requests = n.select(F.col("n_name").alias("request"), F.when(k % 4 == 0, "west").alias("region"), F.when(k % 3 == 0, "std").when((k % 3 == 1) & (k > 18), "big").alias("node_class"), (1 + k % 4).alias("min_zones"), k.alias("added"))
    return inventory.admitted(nodes, requests)


@query(f"""WITH {_RESOURCES}, g AS (SELECT 'ops' AS principal, 'write' AS action, NULL AS o, 'BUILDING' AS p UNION ALL SELECT 'dev', 'read', n_name, NULL FROM nation WHERE n_nationkey < 9),
q AS (SELECT name, organization, project, CASE WHEN kind = 'queue' THEN 'ops' ELSE 'dev' END AS principal, CASE WHEN kind = 'queue' THEN 'write' ELSE 'read' END AS action FROM res)
SELECT name, principal, EXISTS (SELECT 1 FROM g WHERE g.principal = q.principal AND g.action = q.action AND (o IS NULL OR o = organization) AND (p IS NULL OR p = project)) AS allowed FROM q""")
def authorization(spark, sf_dir):
    """Which requests a grant covers."""
    asked = F.col("kind") == "queue"
    requests = resources(spark, sf_dir).select("name", "organization", "project", F.when(asked, "ops").otherwise("dev").alias("principal"), F.when(asked, "write").otherwise("read").alias("action"))
    one = spark.createDataFrame([("ops", "write", None, "BUILDING")], "principal string, action string, organization string, project string")
    many = table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.lit("dev").alias("principal"), F.lit("read").alias("action"), F.col("n_name").alias("organization"), F.lit(None).cast("string").alias("project"))
    return inventory.allowed(requests, one.unionByName(many)).select("name", "principal", "allowed")


@query(f"WITH {ENVELOPES} SELECT key, count(*) AS sessions, max(n) AS longest FROM (SELECT key, s, count(*) AS n FROM (SELECT key, sum(new) OVER (PARTITION BY key ORDER BY time_ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN time_ms - lag(time_ms) OVER (PARTITION BY key ORDER BY time_ms, event_id) <= 7200000 THEN 0 ELSE 1 END AS new FROM env)) GROUP BY 1, 2) GROUP BY 1")
def idle_runs(spark, sf_dir):
    """Each key's runs of events without a pause of over two hours."""
    order = Window.partitionBy("key").orderBy("time_ms", "event_id")
    e = event_envelopes(spark, sf_dir).select("key", "time_ms", "event_id")
    e = e.withColumn("new", F.when(F.col("time_ms") - F.lag("time_ms").over(order) <= 7_200_000, 0).otherwise(1))
    e = e.withColumn("s", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("key", "s").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
