"""Queries over the ordered log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions import hashes
from tallystream.operators import stream
from tallystream.plans.registry import ENVELOPES, RECORD_BYTES, RECORDS, TRANSACTIONS, fnv_sql, query
from tallystream.sources.envelopes import event_envelopes, table, validated
from tallystream.sources.tiers import capture_array, capture_lines, digests, manifest

PARTITIONS = 8
#: A time within the events, and spans back from it.
NOW = 1_706_000_000_000
DAY = 86_400_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to eight partitions by key."""
    return stream.append(event_envelopes(spark, sf_dir), PARTITIONS)


def transactions(spark: SparkSession) -> DataFrame:
    """A few transactions in every state; tx6 of the events isn't among them."""
    return spark.range(1, 6).select(
        F.concat(F.lit("tx"), F.col("id").cast("string")).alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, "pending").when(F.col("id") % 3 == 1, "committed").otherwise("aborted").alias("status"),
    )


@query(f"WITH {ENVELOPES} SELECT event_id, {fnv_sql('key', 16)} AS partition FROM env")
def partition_route(spark, sf_dir):
    """The partition of each event's key."""
    e = event_envelopes(spark, sf_dir)
    return e.select("event_id", hashes.partition_for(F.col("key"), F.col("id"), 16).alias("partition"))


@query(f'WITH {RECORDS} SELECT event_id, partition, "offset" FROM rec')
def offset_assign(spark, sf_dir):
    """Dense offsets in append order."""
    return records(spark, sf_dir).select("event_id", "partition", "offset")


@query(f"WITH {ENVELOPES} SELECT event_id, row_number() OVER (ORDER BY time_ms, event_id) AS commit_position FROM env")
def commit_position(spark, sf_dir):
    """Dense positions over the whole log."""
    return stream.commit_positions(event_envelopes(spark, sf_dir)).select("event_id", "commit_position")


@query(f'WITH {RECORDS} SELECT partition, min("offset") AS base_offset, max("offset") + 1 AS end_offset, count(*) AS records, sum({RECORD_BYTES})::BIGINT AS bytes FROM rec GROUP BY 1')
def partition_bounds(spark, sf_dir):
    """Bounds and bytes of each partition."""
    return stream.bounds(records(spark, sf_dir))


@query(f'WITH {RECORDS} SELECT partition, "offset", event_id FROM rec WHERE partition = 3 AND "offset" >= 20 ORDER BY 2 LIMIT 50')
def fetch_partition(spark, sf_dir):
    """Fifty records of one partition from an offset on."""
    rows = records(spark, sf_dir)
    return stream.fetch(rows, stream.known_bounds(stream.bounds(rows)), 3, 20, 50).select("partition", "offset", "event_id")


@query(f'WITH {RECORDS} SELECT partition, "offset", event_id FROM rec WHERE "offset" >= 10 * partition AND "offset" < 10 * partition + 25')
def fetch_range(spark, sf_dir):
    """Records of every partition from a group's offset on."""
    starts = spark.range(PARTITIONS).select(F.col("id").cast("int").alias("partition"), (F.col("id") * 10).alias("start"))
    return stream.fetch_each(records(spark, sf_dir), starts, 25).select("partition", "offset", "event_id")


@query(f"WITH {RECORDS}, {TRANSACTIONS} SELECT event_id, partition, \"offset\" FROM rec LEFT JOIN tx USING (transaction_id) WHERE transaction_id IS NULL OR coalesce(status = 'committed', false)")
def read_committed(spark, sf_dir):
    """Records that a reader of committed ones sees."""
    return stream.visible(records(spark, sf_dir), transactions(spark)).select("event_id", "partition", "offset")


@query(f"""WITH {ENVELOPES}, firsts AS (SELECT * FROM env QUALIFY row_number() OVER (PARTITION BY dedupe_id ORDER BY time_ms, event_id) = 1),
parts AS (SELECT key, {fnv_sql("key", 8)} AS partition FROM (SELECT DISTINCT key FROM env))
SELECT event_id, partition, row_number() OVER (PARTITION BY partition ORDER BY time_ms, event_id) - 1 AS "offset" FROM firsts JOIN parts USING (key)""")
def dedupe_global(spark, sf_dir):
    """The first event of each dedupe id, numbered."""
    return stream.append(event_envelopes(spark, sf_dir), PARTITIONS, dedupe=True).select("event_id", "partition", "offset")


def _retained(name: str, policy: stream.Retention, condition: str) -> None:
    def run(spark, sf_dir):
        return stream.retained(records(spark, sf_dir), policy, NOW).filter("kept").select("partition", "offset", "event_id")

    run.__name__ = name
    run.__doc__ = f"Records that retention keeps: {policy}."
    query(f"""WITH {RECORDS}, tail AS (SELECT *, row_number() OVER w AS n, sum({RECORD_BYTES}) OVER (PARTITION BY partition ORDER BY "offset" DESC ROWS UNBOUNDED PRECEDING) AS b FROM rec WINDOW w AS (PARTITION BY partition ORDER BY "offset" DESC))
SELECT partition, "offset", event_id FROM tail WHERE {condition}""")(run)


_AGE = f"appended_at_ms > {NOW - 12 * DAY}"
_retained("retain_count", stream.Retention(max_records=100), "n <= 100")
_retained("retain_bytes", stream.Retention(max_bytes=30_000), "b <= 30000")
_retained("retain_age", stream.Retention(max_age_ms=12 * DAY), _AGE)
_retained("retain_combined", stream.Retention(150, 25_000, 12 * DAY), f"n <= 150 AND b <= 25000 AND {_AGE}")


@query(f"""WITH {RECORDS}, marked AS (SELECT partition, {RECORD_BYTES} AS size, {_AGE} AS kept FROM rec)
SELECT partition, count(*) FILTER (NOT kept) AS removed_records, coalesce(sum(size) FILTER (NOT kept), 0)::BIGINT AS removed_bytes, count(*) FILTER (kept) AS retained_records, coalesce(sum(size) FILTER (kept), 0)::BIGINT AS retained_bytes
FROM marked GROUP BY ROLLUP (partition)""")
def retention_report(spark, sf_dir):
    """What retention by age removes and keeps, by partition and in all."""
    return stream.retention_report(stream.retained(records(spark, sf_dir), stream.Retention(max_age_ms=12 * DAY), NOW))


@query(f"WITH {RECORDS} SELECT min(first + {12 * DAY}) AS next_deadline_ms FROM (SELECT min(appended_at_ms) AS first FROM rec GROUP BY partition)")
def retention_deadline(spark, sf_dir):
    """When the oldest record of any partition is too old."""
    return records(spark, sf_dir).agg((F.min("appended_at_ms") + 12 * DAY).alias("next_deadline_ms"))


_COMPACTED = f"""WITH {RECORDS}, {TRANSACTIONS}, st AS (SELECT rec.*, status FROM rec LEFT JOIN tx USING (transaction_id)),
latest AS (SELECT partition, key, max("offset") AS top FROM st WHERE transaction_id IS NULL OR status = 'committed' GROUP BY 1, 2),
marked AS (SELECT st.*, CASE WHEN status = 'pending' THEN true WHEN status = 'aborted' THEN false ELSE coalesce("offset" = top, false) AND (payload IS NOT NULL OR appended_at_ms + {5 * DAY} > {NOW}) END AS kept
  FROM st LEFT JOIN latest USING (partition, key))"""


@query(_COMPACTED + ' SELECT partition, "offset", event_id FROM marked WHERE kept')
def compact_keyed(spark, sf_dir):
    """Records that compaction by key keeps."""
    return stream.compacted(records(spark, sf_dir), transactions(spark), NOW, 5 * DAY).filter("kept").select("partition", "offset", "event_id")


@query(_COMPACTED + f" SELECT partition, count(*) FILTER (NOT kept) AS removed, coalesce(sum({RECORD_BYTES}) FILTER (NOT kept), 0)::BIGINT AS removed_bytes, count(*) FILTER (NOT kept AND payload IS NULL) AS removed_tombstones FROM marked GROUP BY 1")
def compaction_report(spark, sf_dir):
    """What compaction removes from each partition."""
    return stream.compaction_report(stream.compacted(records(spark, sf_dir), transactions(spark), NOW, 5 * DAY))


def _after_retention(spark, sf_dir):
    """Records, and bounds after retention that keeps nothing of partition 6."""
    rows = records(spark, sf_dir)
    marked = stream.retained(rows, stream.Retention(max_records=60), NOW).withColumn("kept", F.col("kept") & (F.col("partition") != 6))
    return marked.filter("kept").drop("kept"), stream.bounds_after(stream.bounds(rows), marked)


_KEPT = f"""WITH {RECORDS}, lim AS (SELECT partition, max("offset") + 1 AS stop FROM rec GROUP BY 1), kept AS (SELECT rec.*, {RECORD_BYTES} AS size, stop FROM rec JOIN lim USING (partition) WHERE "offset" >= stop - 60 AND partition <> 6),
bnd AS (SELECT lim.partition, coalesce(min("offset"), lim.stop) AS base, lim.stop, count("offset") AS records, coalesce(sum(size), 0)::BIGINT AS bytes FROM lim LEFT JOIN kept ON kept.partition = lim.partition GROUP BY lim.partition, lim.stop)"""


@query(_KEPT + " SELECT partition, base AS base_offset, stop AS end_offset, records, bytes FROM bnd")
def bounds_after_retention(spark, sf_dir):
    """Bounds after retention, also of a partition that is empty then."""
    return _after_retention(spark, sf_dir)[1]


@query(_KEPT + ' SELECT event_id, "offset" FROM kept WHERE partition = 3 AND "offset" >= stop - 50 ORDER BY 2 LIMIT 20')
def fetch_after_retention(spark, sf_dir):
    """Records of a partition of which earlier ones are gone."""
    rows, limits = _after_retention(spark, sf_dir)
    known = stream.known_bounds(limits)
    return stream.fetch(rows, known, 3, known[3][1] - 50, 20).select("event_id", "offset")


@query(_KEPT + """, co AS (SELECT partition, CASE WHEN partition % 3 <> 2 THEN stop - 5 - 20 * partition END AS c FROM lim)
SELECT 'audit' AS "group", partition, base AS base_offset, coalesce(c, base) AS committed, stop AS end_offset, greatest(stop - greatest(coalesce(c, base), base), 0) AS lag, coalesce(c, base) < base AS out_of_range FROM bnd JOIN co USING (partition)""")
def lag_after_retention(spark, sf_dir):
    """Lag of a group, some of whose offsets were removed, also on an empty partition."""
    limits = _after_retention(spark, sf_dir)[1]
    committed = F.when(F.col("partition") % 3 != 2, F.col("end_offset") - 5 - 20 * F.col("partition")).cast("bigint")
    return stream.lag(limits, limits.select(F.lit("audit").alias("group"), "partition", committed.alias("committed")))


@query(_COMPACTED + ' SELECT event_id, "offset" FROM marked WHERE kept AND partition = 3 AND "offset" >= 0 ORDER BY 2 LIMIT 40')
def fetch_after_compaction(spark, sf_dir):
    """Records of a compacted partition from the first offset on, which compaction doesn't move."""
    rows = records(spark, sf_dir)
    marked = stream.compacted(rows, transactions(spark), NOW, 5 * DAY)
    limits = stream.bounds_after(stream.bounds(rows), marked, compaction=True)
    return stream.fetch(marked.filter("kept"), stream.known_bounds(limits), 3, 0, 40).select("event_id", "offset")


@query(_KEPT + ', st AS (SELECT partition, greatest(CASE WHEN partition % 2 = 0 THEN stop - 30 ELSE 0 END, base) AS start FROM bnd) SELECT event_id, partition, "offset" FROM kept JOIN st USING (partition) WHERE "offset" >= start AND "offset" < start + 15')
def claimed_group_fetch(spark, sf_dir):
    """Records that the owner of a group reads from each partition's committed offset, or the base."""
    rows, limits = _after_retention(spark, sf_dir)
    offsets = limits.select(F.lit("g").alias("group"), "partition", F.when(F.col("partition") % 2 == 0, F.col("end_offset") - 30).otherwise(0).alias("committed"))
    return stream.fetch_for_group(rows, limits, offsets, "g", 15, owner=("m1", 4), claimed=("m1", 4)).select("event_id", "partition", "offset")


_LAG = f"""WITH {RECORDS}, lim AS (SELECT partition, min("offset") + 40 AS base, max("offset") + 1 AS stop FROM rec GROUP BY 1), off AS (SELECT unnest(['audit', 'billing']) AS grp, p AS partition FROM range(8) t(p)),
co AS (SELECT grp, partition, CASE WHEN partition % 3 <> 2 THEN partition * CASE grp WHEN 'audit' THEN 10 ELSE 20 END END AS c FROM off)
SELECT grp AS "group", partition, base AS base_offset, coalesce(c, base) AS committed, stop AS end_offset, greatest(stop - greatest(coalesce(c, base), base), 0) AS lag, coalesce(c, base) < base AS out_of_range FROM lim JOIN co USING (partition)"""


@query(_LAG)
def consumer_lag(spark, sf_dir):
    """Lag of two groups, some of whose offsets are before the base or missing."""
    limits = stream.bounds(records(spark, sf_dir)).withColumn("base_offset", F.col("base_offset") + 40)
    groups = spark.range(PARTITIONS).select(F.col("id").cast("int").alias("partition"), F.explode(F.array(F.lit("audit"), F.lit("billing"))).alias("group"))
    step = F.when(F.col("group") == "audit", 10).otherwise(20)
    offsets = groups.withColumn("committed", F.when(F.col("partition") % 3 != 2, F.col("partition") * step).cast("bigint"))
    return stream.lag(limits, offsets)


@query(f"""WITH {RECORDS} SELECT member, partition, "offset", event_id FROM (SELECT type AS member, * FROM rec WHERE type IN ('click', 'view', 'error')) ORDER BY appended_at_ms, member, partition, "offset" LIMIT 200""")
def superstream_merge(spark, sf_dir):
    """The first records of three logs, merged by time."""
    rows = records(spark, sf_dir)
    members = {t: rows.filter(F.col("type") == t) for t in ("click", "view", "error")}
    return stream.superstream(members, 200).select("member", "partition", "offset", "event_id")


@query(f"""WITH {ENVELOPES}, tot AS (SELECT type, 1 + (strlen(type) % 4)::INTEGER AS current, count(*) AS records, sum(coalesce(strlen(payload), 0))::BIGINT AS bytes FROM env GROUP BY 1),
w AS (SELECT *, greatest(ceil(records / 500)::BIGINT, 1) AS r, greatest(ceil(bytes / 4000)::BIGINT, 1) AS b FROM tot)
SELECT type, current, records, bytes, greatest(r, b, current) AS advised, CASE WHEN greatest(r, b, current) = current THEN 'within_target' WHEN b >= r THEN 'retained_bytes' ELSE 'retained_records' END AS reason FROM w""")
def partition_advice(spark, sf_dir):
    """Partitions that each type's log should have."""
    rows = event_envelopes(spark, sf_dir)
    totals = rows.groupBy("type").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")).alias("bytes"))
    totals = totals.select("type", (1 + F.length("type") % 4).cast("int").alias("current"), "records", "bytes")
    return stream.advice(totals, 500, 4_000)


@query("""WITH m AS (SELECT s_name AS member, row_number() OVER (ORDER BY s_name) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT s_name FROM supplier))
SELECT member, shard::INTEGER AS shard FROM m, range(64) t(shard) WHERE shard % n = place""")
def session_assignment(spark, sf_dir):
    """Shards of a group's members."""
    return stream.assignment(table(spark, sf_dir, "supplier"), "s_name", 64)


@query(f"""WITH {RECORDS} SELECT partition, "offset", event_id, CASE WHEN "offset" >= 50 THEN 'hot' ELSE 'cold' END AS tier FROM rec""")
def tier_union(spark, sf_dir):
    """Hot records and an older tier that overlap, as one log."""
    rows = records(spark, sf_dir)
    hot, cold = rows.filter("offset >= 50").withColumn("tier", F.lit("hot")), rows.filter("offset < 80").withColumn("tier", F.lit("cold"))
    return stream.tiered(hot, cold).select("partition", "offset", "event_id", "tier")


@query(f"""WITH {RECORDS}, stop AS (SELECT partition, min("offset") AS s FROM rec WHERE transaction_id = 'tx3' AND event_id % 97 = 0 GROUP BY 1)
SELECT partition, "offset", event_id FROM rec LEFT JOIN stop USING (partition) WHERE "offset" < least(400, coalesce(s, 400)) AND "offset" < 300""")
def tier_prefix(spark, sf_dir):
    """What can move to an older tier: below an offset and a pending transaction."""
    rows = records(spark, sf_dir)
    pending = F.when((F.col("transaction_id") == "tx3") & (F.col("event_id") % 97 == 0), "held").otherwise("done")
    held = spark.createDataFrame([("held",)], "transaction_id string")
    return stream.tier_prefix(rows.withColumn("transaction_id", pending), held, 400, 300).select("partition", "offset", "event_id")


@query(f"""WITH {RECORDS} SELECT partition, "offset", '{{"id":"' || id || '","payload":' || coalesce('"' || replace(payload, '"', '\\"') || '"', 'null') || ',"time_ms":' || time_ms || '}}' AS line FROM rec WHERE "offset" >= 5 AND "offset" < 40""")
def capture_export(spark, sf_dir):
    """A range of records as JSON Lines."""
    return capture_lines(records(spark, sf_dir).filter("offset >= 5 AND offset < 40"), ["id", "payload", "time_ms"])


@query(f"""WITH {RECORDS} SELECT event_id, 'repl/west/' || partition || '/' || "offset" AS dedupe_id, CASE WHEN event_id % 5 = 1 THEN 'north,west' ELSE 'west' END AS traversed FROM rec WHERE "offset" >= 10 AND event_id % 5 <> 0""")
def replication_ingest(spark, sf_dir):
    """Foreign records beyond the checkpoint that haven't passed here."""
    passed = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("here"))).when(F.col("event_id") % 5 == 1, F.array(F.lit("north"))).otherwise(F.array().cast("array<string>"))
    batch = records(spark, sf_dir).withColumn("traversed_clusters", passed).withColumn("dedupe_id", F.lit(None).cast("string"))
    return stream.replicated(batch, "west", "here", 10).select("event_id", "dedupe_id", F.col("extensions")["traversed"].alias("traversed"))


@query("""WITH c AS (SELECT 't' || (event_id // 4) AS transaction_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' ELSE 'append' END AS action FROM events),
e AS (SELECT transaction_id, arg_min(action, seq) FILTER (action <> 'append') AS fin, count(*) FILTER (action = 'append') AS records FROM c GROUP BY 1)
SELECT transaction_id, CASE fin WHEN 'commit' THEN 'committed' WHEN 'abort' THEN 'aborted' ELSE 'pending' END AS status, records FROM e""")
def transaction_status(spark, sf_dir):
    """The status of transactions from the commands of all events, four to a transaction."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "abort").otherwise("append")
    ids = F.concat(F.lit("t"), F.floor(F.col("event_id") / 4).cast("string"))
    return stream.transaction_status(e.select(ids.alias("transaction_id"), F.col("event_id").alias("seq"), action.alias("action")))


@query("""WITH a AS (SELECT event_id AS seq, user_id AS producer, event_id // 2000 AS term, row_number() OVER (PARTITION BY user_id, event_id // 2000 ORDER BY event_id) + CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 17 = 0 THEN -1 ELSE 0 END AS sequence FROM events),
b AS (SELECT *, max(sequence) OVER (PARTITION BY producer, term ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a)
SELECT seq, producer, CASE WHEN prev IS NULL THEN 'first' WHEN sequence = prev + 1 THEN 'next' WHEN sequence <= prev THEN 'repeat' ELSE 'gap' END AS kind FROM b""")
def producer_sequences(spark, sf_dir):
    """How producers' appends follow each other."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    term = F.floor(F.col("event_id") / 2000)
    order = Window.partitionBy("user_id", term).orderBy("event_id")
    slip = F.when(F.col("event_id") % 13 == 0, 2).when(F.col("event_id") % 17 == 0, -1).otherwise(0)
    rows = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("producer"), term.alias("term"), (F.row_number().over(order) + slip).alias("sequence"))
    return stream.sequence_report(rows).select("seq", "producer", "kind")


@query("""WITH t AS (SELECT event_id, user_id % 5 AS node, date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000 - CASE WHEN event_id % 4 = 0 THEN 7200000 ELSE 0 END AS p FROM events),
m AS (SELECT *, max(p) OVER (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clock_ms FROM t)
SELECT event_id, node, clock_ms, row_number() OVER (PARTITION BY node, clock_ms ORDER BY event_id) - 1 AS logical FROM m""")
def hybrid_clock(spark, sf_dir):
    """A hybrid logical clock over times that sometimes go back."""
    e = event_envelopes(spark, sf_dir)
    ticks = e.select("event_id", (F.col("user_id") % 5).alias("node"), (F.col("time_ms") - F.when(F.col("event_id") % 4 == 0, 7_200_000).otherwise(0)).alias("physical"))
    return stream.hybrid_clock(ticks, "node", "event_id", "physical").select("event_id", "node", "clock_ms", "logical")


@query("""SELECT problem, count(*) AS events FROM (SELECT CASE WHEN trim(CASE WHEN event_id % 50 = 0 THEN '  ' ELSE event_id::VARCHAR END) = '' THEN 'id' WHEN event_id % 60 > 57 THEN 'priority' END AS problem FROM events) GROUP BY 1""")
def envelope_validation(spark, sf_dir):
    """Envelopes by what is wrong with them."""
    e = event_envelopes(spark, sf_dir)
    broken = e.withColumn("id", F.when(F.col("event_id") % 50 == 0, "  ").otherwise(F.col("id"))).withColumn("priority", F.when(F.col("event_id") % 60 > 57, 12).otherwise(F.col("priority")))
    return validated(broken).groupBy("problem").agg(F.count("*").alias("events"))


_CLOCK = """t AS (SELECT event_id, user_id % 5 AS node, date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000 // 7200000 * 7200000 AS p, CASE WHEN event_id % 3 = 0 THEN date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000 // 7200000 * 7200000 + event_id % 2 * 7200000 END AS r, CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS rl FROM events),
m AS (SELECT *, max(greatest(p, r)) OVER (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clock_ms FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY node, clock_ms ORDER BY event_id) AS i FROM m)"""


@query(f"WITH {_CLOCK} SELECT event_id, node, clock_ms, (i + max(CASE WHEN r = clock_ms THEN rl + 1 - i WHEN i = 1 THEN 0 - i END) OVER (PARTITION BY node, clock_ms ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS logical FROM n")
def hybrid_clock_observe(spark, sf_dir):
    """A hybrid logical clock that observes others, some of which are ahead."""
    e = event_envelopes(spark, sf_dir)
    hours = F.floor(F.col("time_ms") / 7_200_000) * 7_200_000
    seen = F.col("event_id") % 3 == 0
    ticks = e.select("event_id", (F.col("user_id") % 5).alias("node"), hours.alias("own"), F.when(seen, hours + F.col("event_id") % 2 * 7_200_000).alias("remote"), F.when(seen, F.col("event_id") % 40).alias("counter"))
    return stream.hybrid_clock_observed(ticks, "node", "event_id", "own", "remote", "counter").select("event_id", "node", "clock_ms", "logical")


def _tree(rows: str, key: str) -> str:
    """SQL of the digests of ``rows`` (a key, "offset" and ``sha``)."""
    return f"""blk AS (SELECT {key}, "offset" // 4096 AS b, min("offset") AS f, max("offset") AS l, count(*) AS n, sha256(string_agg(sha, ',' ORDER BY "offset")) AS d FROM {rows} GROUP BY 1, 2),
dig AS (SELECT {key}, min(f) AS first_offset, max(l) + 1 AS end_offset, sum(n)::BIGINT AS records, sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM blk GROUP BY 1)"""


@query(f"""WITH {RECORDS}, sh AS (SELECT partition, "offset", sha256('{{"headers":[{{"key":"tenant","value":"' || tenant || '"}}],"id":"' || id || '","offset":' || "offset" || ',"partition":' || partition || ',"transaction_id":' || coalesce('"' || transaction_id || '"', 'null') || '}}') AS sha FROM rec),
{_tree("sh", "partition")} SELECT partition, first_offset, end_offset, records, digest FROM dig""")
def tier_manifest(spark, sf_dir):
    """The manifest of a tier, with a digest of all columns."""
    return manifest(records(spark, sf_dir).select("partition", "offset", "id", "headers", "transaction_id"))


@query(f"""WITH s AS (SELECT event_id // 100 AS partition, event_id % 100 AS i, event_id FROM events),
b AS (SELECT partition, i + CASE WHEN partition % 7 = 1 AND i > 50 THEN 1 ELSE 0 END + CASE WHEN partition % 5 = 2 THEN 100 ELSE 0 END AS "offset", event_id::VARCHAR AS id, CASE WHEN partition % 11 = 3 AND i = 9 THEN '["north","here"]' ELSE '["north"]' END AS t FROM s),
sh AS (SELECT partition, "offset", t, sha256('{{"id":"' || id || '","offset":' || "offset" || ',"partition":' || partition || ',"traversed_clusters":' || t || '}}') AS sha FROM b), {_tree("sh", "partition")},
l AS (SELECT partition, bool_or(t LIKE '%here%') AS passed, count(DISTINCT "offset") AS n FROM b GROUP BY 1)
SELECT partition, first_offset, end_offset AS next_offset, digest, CASE WHEN partition % 13 = 4 THEN 'duplicate' WHEN first_offset <> CASE WHEN partition % 2 = 0 THEN 100 ELSE 0 END THEN 'conflict' WHEN end_offset - first_offset <> records OR n <> records OR records > 128 THEN 'invalid' WHEN passed THEN 'loop' ELSE 'accepted' END AS outcome FROM dig JOIN l USING (partition)""")
def replication_outcomes(spark, sf_dir):
    """Foreign batches of a hundred records: taken, known, at a wrong place, with a gap, or come round."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("partition"), (F.col("event_id") % 100).alias("i"), F.col("event_id").cast("string").alias("id"))
    p = F.col("partition")
    offset = F.col("i") + F.when((p % 7 == 1) & (F.col("i") > 50), 1).otherwise(0) + F.when(p % 5 == 2, 100).otherwise(0)
    passed = F.when((p % 11 == 3) & (F.col("i") == 9), F.array(F.lit("north"), F.lit("here"))).otherwise(F.array(F.lit("north")))
    batch = e.select("partition", offset.alias("offset"), "id", passed.alias("traversed_clusters"))
    known = digests(batch).select("partition", F.when(p % 13 == 4, F.col("digest")).alias("last_digest"))
    checkpoints = known.filter((p % 2 == 0) | (p % 13 == 4)).withColumn("next_offset", F.when(p % 2 == 0, 100).otherwise(0))
    return stream.replication_outcomes(batch, checkpoints, "here")


@query(f"""WITH {RECORDS}, r AS (SELECT *, min("offset") OVER w AS f, max("offset") OVER w AS l FROM rec WHERE "offset" >= 5 AND "offset" < 40 WINDOW w AS (PARTITION BY partition))
SELECT partition, "offset", CASE WHEN "offset" = f THEN '[' ELSE ',' END || '{{"id":"' || id || '","time_ms":' || time_ms || '}}' || CASE WHEN "offset" = l THEN ']' ELSE '' END AS line FROM r""")
def capture_json_array(spark, sf_dir):
    """A range of records as one JSON array a partition."""
    return capture_array(records(spark, sf_dir).filter("offset >= 5 AND offset < 40"), ["id", "time_ms"])


@query(f"""WITH {ENVELOPES}, b AS (SELECT *, event_id // 40 AS batch, event_id % 40 - CASE WHEN event_id % 200 = 199 THEN 1 ELSE 0 END AS client_sequence FROM env),
ok AS (SELECT * FROM b WHERE batch IN (SELECT batch FROM b GROUP BY 1 HAVING count(*) <= 1000 AND count(*) = count(DISTINCT client_sequence))),
parts AS (SELECT key, {fnv_sql("key", 8)} AS partition FROM (SELECT DISTINCT key FROM env))
SELECT batch, client_sequence, partition, row_number() OVER (PARTITION BY partition ORDER BY time_ms, event_id) - 1 AS "offset" FROM ok JOIN parts USING (key)""")
def batch_receipts(spark, sf_dir):
    """Receipts of atomic batches, some of which have a sequence twice."""
    e = event_envelopes(spark, sf_dir)
    slip = F.when(F.col("event_id") % 200 == 199, 1).otherwise(0)
    rows = e.withColumn("batch", F.floor(F.col("event_id") / 40)).withColumn("client_sequence", F.col("event_id") % 40 - slip)
    return stream.batch_receipts(rows, PARTITIONS).select("batch", "client_sequence", "partition", "offset")


@query("""WITH s AS (SELECT 'm' || (user_id % 20) AS member, max(date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000) + 600000 AS until FROM events GROUP BY 1)
SELECT p AS partition, 'm' || (p % 23) AS member FROM range(64) t(p) WHERE 'm' || (p % 23) NOT IN (SELECT member FROM s WHERE until > (SELECT max(until) - 10000000 FROM s))""")
def expired_owners(spark, sf_dir):
    """Partitions whose owner's session is over."""
    e = event_envelopes(spark, sf_dir)
    sessions = e.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("member")).agg((F.max("time_ms") + 600_000).alias("expires_at_ms"))
    now = sessions.agg(F.max("expires_at_ms")).first()[0] - 10_000_000
    owned = spark.range(64).select(F.col("id").alias("partition"), F.concat(F.lit("m"), (F.col("id") % 23).cast("string")).alias("member"))
    return stream.expired_owners(owned, sessions, now).select("partition", "member")


@query(f"WITH s AS (SELECT 'c' || user_id AS name, min(date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000) + user_id % 9 * 86400000 AS next_at_ms FROM events GROUP BY user_id) SELECT name, next_at_ms FROM s WHERE next_at_ms <= {1_704_067_200_000 + 4 * DAY} ORDER BY 2, 1 LIMIT 32")
def due_captures(spark, sf_dir):
    """Scheduled captures whose time has come, in order."""
    e = event_envelopes(spark, sf_dir)
    schedules = e.groupBy("user_id").agg(F.min("time_ms").alias("first")).select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name"), (F.col("first") + F.col("user_id") % 9 * 86_400_000).alias("next_at_ms"))
    return stream.due(schedules, 1_704_067_200_000 + 4 * DAY, 32)
