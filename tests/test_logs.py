"""Operators over logs, subscriptions, state and queues, on small examples."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallystream.operators import bus, cache, inventory, ordered, queue, stream
from tallystream.sources import envelopes, tiers


def log(spark, rows):
    """Records (partition, offset, id, key, payload, transaction, appended)."""
    return spark.createDataFrame(rows, "partition int, offset long, id string, key string, payload string, transaction_id string, appended_at_ms long")


def events(spark, rows):
    """Envelopes (id, key, time, dedupe id)."""
    return spark.createDataFrame([(i, k, t, d, n) for n, (i, k, t, d) in enumerate(rows)], "id string, key string, time_ms long, dedupe_id string, event_id long")


@pytest.mark.parametrize("bucket", [None, 10])
def test_append_numbers_densely(spark, bucket):
    r = random.Random(3)
    rows = [(f"e{n}", r.choice(["a", "b", "c", "", None]), n // 3, r.choice([None, "d1", "d2", f"u{n}"])) for n in range(200)]
    for dedupe in (False, True):
        found = stream.append(events(spark, rows).repartition(5), 4, dedupe=dedupe, bucket_ms=bucket).orderBy("time_ms", "event_id").collect()
        seen, ends = set(), {}
        kept = iter(found)
        for n, (i, _, _, d) in enumerate(rows):
            if dedupe and d in seen and d is not None:
                continue
            seen.add(d)
            x = next(kept)
            assert (x.event_id, x.id, x.offset) == (n, i, ends.get(x.partition, 0))
            ends[x.partition] = x.offset + 1
        assert next(kept, None) is None


def test_commit_positions(spark):
    found = stream.commit_positions(events(spark, [(f"e{n}", "k", n, None) for n in range(50)]).repartition(4), bucket_ms=7).orderBy("event_id").collect()
    assert [r.commit_position for r in found] == list(range(1, 51))


def test_fetch_and_lag(spark):
    records = log(spark, [(0, o, f"r{o}", "k", "{}", None, o) for o in range(5, 9)])
    limits = stream.known_bounds(stream.bounds(records))
    assert [r.offset for r in stream.fetch(records, limits, 0, 6, 2).collect()] == [6, 7]
    assert stream.fetch(records, limits, 0, 99, 2).collect() == []
    with pytest.raises(stream.Conflict):
        stream.fetch(records, limits, 0, 4, 2)
    with pytest.raises(ValueError):
        stream.fetch(records, limits, 1, 4, 2)
    offsets = spark.createDataFrame([("g", 0, 6), ("h", 0, None), ("i", 0, 2), ("j", 0, 9)], "group string, partition int, committed long")
    found = {r.group: (r.lag, r.out_of_range) for r in stream.lag(stream.bounds(records), offsets).collect()}
    assert found == {"g": (3, False), "h": (4, False), "i": (4, True), "j": (0, False)}


def test_group_fetch_and_lookups(spark):
    records = log(spark, [(p, o, f"{p}{o}", "k", "{}", None, o) for p in range(2) for o in range(3, 8)])
    offsets = spark.createDataFrame([("g", 0, 6), ("h", 1, 1)], "group string, partition int, committed long")
    limits = stream.bounds(records)
    found = stream.fetch_for_group(records, limits, offsets, "g", 2)
    assert sorted(r.id for r in found.collect()) == ["06", "07", "13", "14"]
    assert stream.fetch_for_group(records, limits, offsets, "h", 1).filter("partition = 1").first().id == "13"
    with pytest.raises(stream.Conflict):
        stream.fetch_for_group(records, limits, offsets, "g", 2, ("m", 1), ("m", 2))
    messages = spark.createDataFrame([("a", "dead_lettered"), ("b", "ready")], "id string, state string")
    letters = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "id string, dead_at_ms long")
    assert queue.dead_letter(messages, letters, "a").first().dead_at_ms == 5 and queue.dead_letter(messages, letters, "b").first() is None
    name = dict.fromkeys(inventory.NAME_PARTS, "x")
    catalog = spark.createDataFrame([(*name.values(), s, f"t{s}") for s in range(3)], [*name, "shard", "tablet"])
    assert inventory.route(catalog, name, 2).first().tablet == "t2"
    with pytest.raises(ValueError):
        inventory.route(catalog, {"name": "x"}, 0)
    entries = spark.createDataFrame([("b", "cold"), ("a", "cold"), ("c", "memory")], "key string, storage_class string")
    assert [r.key for r in cache.of_class(entries, "cold").collect()] == ["a", "b"]


def size(row):
    """Bytes of the canonical JSON of a record of :func:`log`."""
    names = ("partition", "offset", "appended_at_ms", "id", "key", "transaction_id")
    fields = dict(zip(("partition", "offset", "id", "key", "payload", "transaction_id", "appended_at_ms"), row, strict=True))
    rest = json.dumps({c: fields[c] for c in names if fields[c] is not None}, separators=(",", ":"))
    return len(rest) + (len(fields["payload"]) + 11 if fields["payload"] is not None else 0)


def test_bounds_outlive_records(spark):
    """Cases of truncated, aged, combined and emptied logs."""
    rows = [(0, 0, "one", "k", "1", None, 100), (0, 1, "two", "k", "2", None, 109), (1, 0, "x", "k", None, None, 100)]
    records = log(spark, rows)
    limits = stream.bounds(records)
    assert stream.known_bounds(limits) == {0: (0, 2), 1: (0, 1)}
    assert {r.partition: r.bytes for r in limits.collect()} == {0: size(rows[0]) + size(rows[1]), 1: size(rows[2])}
    marked = stream.retained(records, stream.Retention(max_age_ms=10), 110)
    after = stream.bounds_after(limits, marked)
    assert sorted(map(tuple, after.collect())) == [(0, 1, 2, 1, size(rows[1])), (1, 1, 1, 0, 0)]
    known, left = stream.known_bounds(after), marked.filter("kept")
    assert [r.id for r in stream.fetch(left, known, 0, 1, 10).collect()] == ["two"] and stream.fetch(left, known, 1, 1, 10).collect() == []
    for partition in (0, 1):
        with pytest.raises(stream.Conflict):
            stream.fetch(left, known, partition, 0, 10)
    offsets = spark.createDataFrame([("w", 0, 0), ("w", 1, 0)], "group string, partition int, committed long")
    assert sorted((r.partition, r.lag, r.out_of_range) for r in stream.lag(after, offsets).collect()) == [(0, 1, True), (1, 0, True)]
    gone = stream.compacted(records, spark.createDataFrame([], "transaction_id string, status string"), 110, 10)
    kept = stream.bounds_after(limits, gone, compaction=True)
    assert stream.known_bounds(kept) == {0: (0, 2), 1: (0, 1)}
    assert [r.id for r in stream.fetch(gone.filter("kept"), stream.known_bounds(kept), 0, 0, 10).collect()] == ["two"]
    again = stream.bounds_after(after, marked.withColumn("kept", F.lit(False)))
    assert stream.known_bounds(again) == {0: (2, 2), 1: (1, 1)}


@pytest.mark.parametrize("bucket", [None, 5])
def test_retention_equals_appending(spark, bucket):
    r = random.Random(7)
    rows, now = [], 0
    for o in range(120):
        now += r.randrange(3)
        rows.append((o % 2, o // 2, f"r{o}", "k", "x" * r.randrange(6) or None, None, now))
    for policy in (stream.Retention(5), stream.Retention(None, 400), stream.Retention(None, None, 9), stream.Retention(7, 600, 30)):
        found = {(x.partition, x.offset) for x in stream.retained(log(spark, rows), policy, now, bucket).filter("kept").collect()}
        kept: dict[int, list] = {0: [], 1: []}
        for row in rows:
            p, o, at = row[0], row[1], row[6]
            kept[p].append((o, size(row), at))
            for part in kept.values():
                while part and (
                    (policy.max_records is not None and len(part) > policy.max_records)
                    or (policy.max_bytes is not None and sum(x[1] for x in part) > policy.max_bytes)
                    or (policy.max_age_ms is not None and at >= policy.max_age_ms and part[0][2] <= at - policy.max_age_ms)
                ):
                    part.pop(0)
        assert found == {(p, x[0]) for p, part in kept.items() for x in part}, policy


def test_compaction(spark):
    rows = [(0, 0, "a1", "a", "1", None, 1), (0, 1, "b1", "b", "1", None, 2), (0, 2, "a2", "a", "2", None, 3), (0, 3, "free", None, "3", None, 4), (0, 4, "b2", "b", None, None, 5)]
    none = spark.createDataFrame([], "transaction_id string, status string")
    found = stream.compacted(log(spark, rows), none, 20, 10)
    assert [r.id for r in found.filter("kept").orderBy("offset").collect()] == ["a2", "free"]
    assert found.filter("NOT kept AND payload IS NULL").count() == 1
    rows = [(0, 0, "p", "a", "1", "pending", 1), (0, 1, "x", None, "1", "aborted", 2), (0, 2, "u", "a", "2", "unknown", 3), (0, 3, "v", None, "2", "unknown", 3), (0, 4, "c", "a", "2", "committed", 3)]
    states = spark.createDataFrame([(s, s) for s in ("pending", "aborted", "committed")], "transaction_id string, status string")
    assert {r.id for r in stream.compacted(log(spark, rows), states, 20, 10).filter("kept").collect()} == {"p", "v", "c"}
    assert {r.id for r in stream.visible(log(spark, rows), states).collect()} == {"c"}
    assert stream.visible(log(spark, rows), states, committed=False).count() == 5


def test_advice_and_superstream(spark):
    totals = spark.createDataFrame([(2, 1000, 10_000), (2, 1, 1), (1, 400, 8_000), (3, 0, 0)], "current int, records long, bytes long")
    found = [(r.advised, r.reason) for r in stream.advice(totals, 200, 4_000).collect()]
    assert found == [(5, "retained_records"), (2, "within_target"), (2, "retained_bytes"), (3, "within_target")]
    a, b = (log(spark, [(0, 0, m, "k", "{}", None, 5)]) for m in "ab")
    assert [r.member for r in stream.superstream({"b": b, "a": a}, 10).collect()] == ["a", "b"]


def test_tiers(spark, tmp_path):
    records = log(spark, [(p, o, f"{p}{o}", "k", "{}", None, o) for p in range(2) for o in range(6)])
    manifest = tiers.write_tier(records.filter("offset < 4"), f"{tmp_path}/tier")
    cold = tiers.verified_tier(spark, f"{tmp_path}/tier", manifest)
    both = stream.tiered(records.filter("offset >= 2").withColumn("from", F.lit("hot")), cold.withColumn("from", F.lit("cold")))
    assert sorted((r.partition, r.offset, r["from"]) for r in both.collect()) == [(p, o, "hot" if o >= 2 else "cold") for p in range(2) for o in range(6)]
    with pytest.raises(ValueError):
        tiers.verified_tier(spark, f"{tmp_path}/tier", manifest.withColumn("digest", F.lit("0" * 64)))
    tagged = records.withColumn("headers", F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.col("id")))
    first = tiers.manifest(tagged).collect()
    assert tiers.manifest(tagged.withColumn("headers", F.create_map(F.lit("a"), F.col("id"), F.lit("b"), F.lit("1")))).collect() == first
    changed = F.when(F.col("id") == "13", F.create_map(F.lit("b"), F.lit("2"))).otherwise(F.col("headers"))
    assert [a.digest == b.digest for a, b in zip(sorted(first), sorted(tiers.manifest(tagged.withColumn("headers", changed)).collect()), strict=True)] == [True, False]
    with pytest.raises(Exception, match="twice"):
        tiers.manifest(records.union(records.filter("id = '03'"))).collect()
    with pytest.raises(ValueError):
        stream.tier_prefix(records, records.select("transaction_id"), 9, 1_025)
    tiers.write_capture(records, f"{tmp_path}/capture", ["id", "transaction_id"])
    assert spark.read.text(f"{tmp_path}/capture/partition=1").first()[0] == '{"id":"10","transaction_id":null}'
    tiers.write_capture(records, f"{tmp_path}/array", ["id"], array=True)
    (part,) = (tmp_path / "array" / "partition=1").glob("*.txt")
    assert json.loads(part.read_text()) == [{"id": f"1{k}"} for k in range(6)]


@pytest.mark.parametrize("codec", ["none", "gzip", "lz4", "snappy", "zstd"])
def test_batches(spark, codec):
    records = [{"client_sequence": i, "payload": {"é": i}} for i in range(20)]
    packed = tiers.encode_batch(records, codec)
    assert tiers.decode_batch(codec, packed) == records
    found = tiers.decoded_batches(spark.createDataFrame([(codec, packed), (codec, "!"), ("none", tiers.encode_batch([{"client_sequence": 1}, {"client_sequence": 1}]))], "codec string, payload string")).collect()
    assert len(found[0].records) == 20 and found[1].problem and "twice" in found[2].problem


def test_replication(spark):
    rows = [(0, 5, ["x"], {"a": "1"}, None), (0, 6, ["here"], {}, None), (0, 3, [], {}, None), (0, 7, [], {"origin_cluster": "old"}, "own")]
    batch = spark.createDataFrame(rows, "partition int, offset long, traversed_clusters array<string>, extensions map<string,string>, dedupe_id string")
    found = {r.offset: r for r in stream.replicated(batch, "west", "here", 5).collect()}
    assert set(found) == {5, 7} and found[5].dedupe_id == "repl/west/0/5" and found[7].dedupe_id == "own"
    assert found[5].extensions == {"a": "1", "origin_cluster": "west", "origin_partition": "0", "origin_offset": "5", "traversed": "x,west"}


def test_replication_outcomes(spark):
    schema = "partition int, offset long, id string, traversed_clusters array<string>"
    batch = lambda p, offsets, passed=(): [(p, o, f"{p}.{o}", list(passed)) for o in offsets]
    rows = [*batch(0, [0, 1, 2]), *batch(1, [5, 6]), *batch(2, [0, 2]), *batch(3, [0], ["here"]), *batch(4, [3]), *batch(5, [0, 1]), *batch(6, range(129)), *batch(7, [0, 0])]
    table = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "partition int, next_offset long, last_digest string")
    found = {r.partition: r for r in stream.replication_outcomes(table, none, "here").collect()}
    assert {p: r.outcome for p, r in found.items()} == {0: "accepted", 1: "conflict", 2: "invalid", 3: "loop", 4: "conflict", 5: "accepted", 6: "invalid", 7: "invalid"}
    after = spark.createDataFrame([(0, 3, found[0].digest), (1, 5, "x"), (4, 2, "y"), (5, 2, "z")], "partition int, next_offset long, last_digest string")
    again = stream.replication_outcomes(table, after, "here")
    assert {r.partition: r.outcome for r in again.collect() if r.partition in (0, 1, 4, 5)} == {0: "duplicate", 1: "accepted", 4: "conflict", 5: "conflict"}
    assert sorted(r.id for r in stream.accepted(table, again).collect()) == ["1.5", "1.6"]
    changed = table.withColumn("id", F.when(F.col("id") == "0.1", "other").otherwise(F.col("id")))
    assert stream.replication_outcomes(changed, after, "here").filter("partition = 0").first().outcome == "conflict"


@pytest.mark.parametrize("bucket", [5, 1000])
def test_plans_as_of(spark, bucket):
    r = random.Random(6)
    changes = [(v, r.randrange(100)) for v in range(1, 12)] + [(99, None)]
    times = [r.choice([None, *range(-5, 110)]) for _ in range(150)]
    found = ordered.as_of(spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k long, time_ms long"), "time_ms", spark.createDataFrame(changes, "version long, at_ms long"), "at_ms", "version", bucket)
    assert found.columns == ["k", "time_ms", "version"] and found.count() == 150
    for x in found.collect():
        before = [(a, v) for v, a in changes if a is not None and x.time_ms is not None and a <= x.time_ms]
        assert x.version == (max(before)[1] if before else None)


@pytest.mark.parametrize("per_bucket", [None, 7, 1 << 20])
def test_clocks_that_observe(spark, per_bucket):
    r = random.Random(2)
    ticks = [(n, r.randrange(6), r.choice([None, r.randrange(7)]), r.randrange(4)) for n in range(80)]
    found = stream.hybrid_clock_observed(spark.createDataFrame([(0, *t) for t in ticks], "node int, n long, own long, remote long, counter long"), "node", "n", "own", "remote", "counter", per_bucket).orderBy("n").collect()
    at, logical = -1, 0
    for (_, own, remote, counter), row in zip(ticks, found, strict=True):
        new = max(at, own, -1 if remote is None else remote)
        behind = [c for t, c in ((at, logical), (remote, counter)) if t == new]
        at, logical = new, 1 + max(behind) if behind else 0
        assert (row.clock_ms, row.logical) == (at, logical)


def bus_event(spark, **change):
    row = {"type": "order.created", "source": "checkout", "subject": "s", "headers": {"tenant": "acme"}, "payload": '{"order":{"total":42},"private":"remove","none":null}', "time_ms": 10} | change
    return spark.createDataFrame([row], "type string, source string, subject string, headers map<string,string>, payload string, time_ms long")


def test_fan_out(spark):
    wanted = bus.EventFilter(("order.*",), ("check*",), ("s",), (("tenant", "acme"),), (("order.total", "42"),))
    subs = [bus.Subscription("worker", wanted), bus.Subscription("audit", wanted, add_headers=(("routed-by", "x"),), projection=(("total", "order.total"), ("gone", "no.where"), ("none", "none")))]
    found = bus.fan_out(bus_event(spark), subs).collect()
    assert [r.subscription for r in found] == ["audit", "worker"]
    assert found[0].headers == {"tenant": "acme", "routed-by": "x"} and found[0].payload == '{"none":null,"total":42}'
    for change in ({"type": "payment.created"}, {"source": "other"}, {"subject": None}, {"headers": {"tenant": "b"}}, {"headers": None}, {"payload": '{"order":{"total":42.0}}'}, {"payload": None}):
        assert bus.fan_out(bus_event(spark, **change), subs).count() == 0, change
    assert bus.fan_out(bus_event(spark, headers=None), [bus.Subscription("a", add_headers=(("k", "v"),))]).first().headers == {"k": "v"}


def test_replay_bounds(spark):
    archive = bus_event(spark).unionByName(bus_event(spark, type="order.cancelled", time_ms=20)).withColumn("position", F.col("time_ms"))
    assert [r.time_ms for r in bus.replay(archive, 10, 20).collect()] == [10, 20]
    assert bus.replay(archive, 0, 100, bus.EventFilter(("*.cancelled",))).count() == 1
    with pytest.raises(ValueError):
        bus.replay(archive, 0, 1, limit=0)


@pytest.mark.parametrize("per_bucket", [None, 9, 1 << 20])
def test_keyed_history(spark, per_bucket):
    r = random.Random(5)
    rows = [(f"k{r.randrange(6)}", n, r.choice([None, "x", "y", "z"])) for n in range(1, 80)]
    changes = spark.createDataFrame(rows, "key string, revision long, value string")
    images = cache.change_images(changes, per_bucket)

    def state(until):
        out = {}
        for k, n, v in rows:
            if n <= until:
                out[k] = v
        return {k: v for k, v in out.items() if v is not None}

    for revision in (0, 10, 40, 79):
        assert {x.key: x.value for x in cache.at_revision(cache.last_writes(changes), images, revision).collect()} == state(revision)
    before, after = state(20), state(79)
    found = {x.key: (x.before, x.after) for x in cache.difference(cache.last_writes(changes.filter("revision <= 20")), cache.last_writes(changes)).collect()}
    assert found == {k: (before.get(k), after.get(k)) for k in set(before) | set(after) if before.get(k) != after.get(k)}


def test_typed_values(spark):
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        cache.counters(spark.createDataFrame([("a", 2**63 - 1), ("a", 1)], "key string, delta long")).collect()
    with pytest.raises(Exception, match="finite"):
        cache.sorted_sets(spark.createDataFrame([("a", "m", float("inf"), 1)], "key string, member string, score double, seq long")).collect()
    fields = cache.hash_fields(spark.createDataFrame([("k", "b", 1, "x"), ("k", "a", 2, "y"), ("k", "b", 3, None), ("k", "a", 4, "z")], "key string, field string, seq long, value string")).first()
    assert [tuple(f) for f in fields.fields] == [("a", "z")]


def test_eviction(spark):
    entries = spark.createDataFrame([("b", 5, 1, 100), ("a", 5, 2, None), ("c", 1, 9, 50)], "key string, last_access_revision long, access_count long, expires_at_ms long")
    assert [r.key for r in cache.victims(entries, "all_keys_lru", 2).collect()] == ["c", "a"]
    assert [r.key for r in cache.victims(entries, "volatile_lfu", 5).collect()] == ["b", "c"]
    assert [r.key for r in cache.victims(entries, "volatile_ttl", 1).collect()] == ["c"]
    assert [r.key for r in cache.expired(entries, 50).collect()] == ["c"]
    with pytest.raises(ValueError):
        cache.victims(entries, "no_eviction", 1)


def test_queue_orders(spark):
    rows = [("old-low", 1, 0, 0), ("new-high", 2, 19, 2)]
    messages = spark.createDataFrame([(i, p, t, pri, "ready", None) for i, p, t, pri in rows], "id string, commit_position long, enqueued_at_ms long, priority int, state string, session_id string")
    assert queue.aged_order(messages, 20, 10, 1).first().id == "old-low"
    assert queue.ready_order(messages, 1).first().id == "new-high"


def test_running_totals(spark):
    df = spark.createDataFrame([("a", n, n % 4) for n in range(60)], "k string, n long, v long").repartition(7)
    for newest in (False, True):
        one = ordered.running_total(df, ["k"], ["n"], F.col("v"), "t", None, newest).select("n", "t").collect()
        two = ordered.running_total(df, ["k"], ["n"], F.col("v"), "t", F.floor(F.col("n") / 9), newest).select("n", "t").collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_carried_values(spark):
    r = random.Random(3)
    rows = [(r.choice("aab"), n, r.choice([None, *range(20)])) for n in [None, *r.sample(range(-40, 200), 90)]]
    df = spark.createDataFrame(rows, "k string, n long, v long").repartition(5)
    for latest in (False, True):
        for inclusive in (False, True):
            want, seen = {}, {}
            for k, n, v in sorted(rows, key=lambda x: (x[1] is not None, x[1])):
                before = seen.setdefault(k, [])
                known = before + [v] if inclusive else list(before)
                want[n] = (known[-1] if known else None) if latest else max((x for x in known if x is not None), default=None)
                before.append(v)
            for per_bucket in (None, 1, 13, 1 << 20):
                found = ordered.carried(df, ["k"], "n", F.col("v"), "c", per_bucket, latest, inclusive)
                assert sorted(found.columns) == ["c", "k", "n", "v"]
                assert {x.n: x.c for x in found.collect()} == want, (latest, inclusive, per_bucket)


def test_byte_victims_by_buckets(spark):
    r = random.Random(4)
    rows = [(f"k{n:02}", "x" * r.randrange(60), r.choice(["memory", "cold"]), r.choice([None, *range(30)])) for n in range(60)]
    entries = spark.createDataFrame(rows, "key string, value string, storage_class string, last_access_revision long")
    budgets = {"memory": 900, "cold": 400}
    gone = set()
    for name, budget in budgets.items():
        mine = sorted((x for x in rows if x[2] == name), key=lambda x: (x[3] is not None, x[3], x[0]))
        left = sum(len(k) + len(v) + cache.ENTRY_BYTES for k, v, _, _ in mine)
        for k, v, _, _ in mine:
            if left > budget:
                gone.add(k)
                left -= len(k) + len(v) + cache.ENTRY_BYTES
    for per_bucket in (None, 4, 1 << 20):
        assert {x.key for x in cache.byte_victims(entries, ["last_access_revision"], budgets, per_bucket).collect()} == gone


@pytest.mark.parametrize("per_bucket", [None, 4, 1 << 20])
def test_sequences_by_buckets(spark, per_bucket):
    r = random.Random(9)
    rows = [(n, r.choice("pq"), 1, r.randrange(12)) for n in range(60)]
    found = stream.sequence_report(spark.createDataFrame(rows, "seq long, producer string, term long, sequence long"), per_bucket)
    most: dict[str, int] = {}
    want = {}
    for n, p, _, s in rows:
        last = most.get(p)
        want[n] = "first" if last is None else "next" if s == last + 1 else "repeat" if s <= last else "gap"
        most[p] = max(s, most.get(p, s))
    assert {x.seq: x.kind for x in found.collect()} == want


def test_placement_and_grants(spark):
    nodes = spark.createDataFrame([("w", "z1", "std", 5), ("w", "z2", "std", 3)], "node_region string, zone string, class string, available int")
    requests = spark.createDataFrame([("ok", "w", None, 2, 3), ("full", None, None, 1, 4), ("zones", None, "std", 3, 0), ("class", None, "big", 1, 0)], "request string, region string, node_class string, min_zones int, added int")
    assert {r.request: r.decision for r in inventory.admitted(nodes, requests).collect()} == {"ok": "admitted", "full": "consensus_group_capacity", "zones": "insufficient_zones", "class": "fixed_voters_ineligible"}
    grants = spark.createDataFrame([("p", "read", "o", None)], "principal string, action string, organization string, project string")
    asked = spark.createDataFrame([("p", "read", "o", "x"), ("p", "write", "o", "x"), ("p", "read", "q", "x")], "principal string, action string, organization string, project string")
    assert sorted((r.action, r.organization, r.allowed) for r in inventory.allowed(asked, grants).collect()) == [("read", "o", True), ("read", "q", False), ("write", "o", False)]


def test_envelope_source(spark, tmp_path):
    good = '{"id":"a","source":"tests","type":"t","time_ms":1000,"dedupe_id":"d","payload":{"subject":"one"}}'
    (tmp_path / "e.json").write_text(good + "\n")
    row = envelopes.read_json_envelopes(spark, str(tmp_path)).first()
    assert (row.id, row.time_ms, row.payload) == ("a", 1000, '{"subject":"one"}')
    (tmp_path / "f.json").write_text("broken\n")
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        envelopes.read_json_envelopes(spark, str(tmp_path)).collect()
