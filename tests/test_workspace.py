"""The workspace, streaming pipelines and webhooks."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tallystream.functions import webhook
from tallystream.operators import bus
from tallystream.streaming import folds, pipelines
from tallystream.workspace import Workspace

ENVELOPE = "id string, source string, type string, subject string, time_ms long, key string, headers map<string,string>, payload string, priority int, dedupe_id string, event_id long"


def rows(start, n):
    return [(f"e{i}", "tests", "order.created", None, 1_000 - i, f"k{i % 5}", {"tenant": "a"}, json.dumps({"n": i}), 0, None, i) for i in range(start, start + n)]


def test_stream_resources(spark, tmp_path):
    w = Workspace(spark, f"{tmp_path}/w")
    assert w.health() == {"status": "ok", "resources": 0, "kinds": []}
    w.create("stream", "orders", partitions=3)
    assert w.poll("orders", 0, 0, 5, 10) == []
    for bad in (("stream", "orders"), ("table", "x"), ("queue", "a b")):
        with pytest.raises(ValueError):
            w.create(*bad)
    with pytest.raises(KeyError):
        w.fetch("nothing", 0, 0, 1)
    for start in (0, 20):
        assert w.append("orders", spark.createDataFrame(rows(start, 20), ENVELOPE)) == 20
    with pytest.raises(ValueError):
        w.append("orders", spark.createDataFrame([(" ", *rows(50, 1)[0][1:])], ENVELOPE))
    ends = {}
    for r in w.records("orders").orderBy("partition", "offset").collect():
        assert r.offset == ends.get(r.partition, 0)
        ends[r.partition] = r.offset + 1
    assert sum(ends.values()) == 40
    p = max(ends, key=ends.get)
    assert [r.offset for r in w.fetch("orders", p, 2, 3).collect()] == [2, 3, 4]
    lag = w.lag("orders", spark.createDataFrame([("g", p, 1)], "group string, partition int, committed long")).first()
    assert lag.lag == ends[p] - 1
    assert w.health() == {"status": "ok", "resources": 1, "kinds": ["stream"]}
    assert w.consume("orders").isStreaming
    assert [r.offset for r in w.poll("orders", p, 1, 2)] == [1, 2]


def test_stateful_resources(spark, tmp_path):
    w = Workspace(spark, f"{tmp_path}/w")
    for kind in ("queue", "cache", "bus"):
        w.create(kind, "x")
    w.apply("queue", "x", [{"op": "enqueue", "now_ms": 0, "id": "a"}])
    assert w.apply("queue", "x", [{"op": "acquire", "now_ms": 1, "consumer": "c"}])[0]["leased"][0]["id"] == "a"
    out = w.apply("cache", "x", [{"op": "multiplex", "now_ms": 0, "mutations": [{"id": "1", "operations": [{"op": "set", "key": "k", "value": 1}]}, {"id": "2", "operations": [{"op": "hash_put", "key": "k", "field": "f", "value": 1}]}]}])
    assert [o["ok"] for o in out[0]["outcomes"]] == [True, False]
    put = {"op": "upsert", "now_ms": 5, "name": "s", "spec": {}}
    assert [a["version"] for a in w.apply("bus", "x", [put, put, {"op": "remove", "now_ms": 6, "name": "s"}, {"op": "remove", "now_ms": 6, "name": "s"}])] == [1, 2, 3, 3]
    assert [json.loads(r.command)["op"] for r in w.journal("queue", "x").collect()] == ["enqueue", "acquire"]
    log = spark.createDataFrame([("q1", 1, '{"op":"enqueue","now_ms":0,"id":"a"}'), ("q2", 1, '{"op":"nothing"}')], "shard string, seq long, command string")
    assert {r.shard: r.ok for r in w.apply_log("queue", log).collect()} == {"q1": True, "q2": False}


def test_bus_resources(spark, tmp_path):
    w = Workspace(spark, f"{tmp_path}/w")
    w.create("bus", "b")
    w.create("queue", "known")
    subs = [bus.Subscription("one", bus.EventFilter(("order.*",)), "queue:known"), bus.Subscription("two", target="queue:unknown")]
    for start in (0, 3):
        found = w.publish("b", spark.createDataFrame(rows(start, 3), ENVELOPE), subs).groupBy("status").count().collect()
        assert {r["status"]: r["count"] for r in found} == {"delivered": 3, "target_missing": 3}
    assert [r.position for r in w.replay("b", 0, 2_000).collect()] == [1, 2, 3, 4, 5, 6]


def test_streaming_offsets_and_publishing(spark, tmp_path):
    subs = [bus.Subscription("all")]
    for part in range(3):
        spark.createDataFrame(rows(part * 10, 10), ENVELOPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ENVELOPE).parquet(f"{tmp_path}/in")
        log = pipelines.append_stream(source, 3).writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
        log.awaitTermination()
        pipelines.publish(source, subs, f"{tmp_path}/archive", f"{tmp_path}/outbox", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    ends, clock = {}, {}
    for r in spark.read.parquet(f"{tmp_path}/log").orderBy("partition", "offset").collect():
        assert r.offset == ends.get(r.partition, 0) and r.appended_at_ms >= clock.get(r.partition, 0)
        ends[r.partition], clock[r.partition] = r.offset + 1, r.appended_at_ms
    assert sum(ends.values()) == 30
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 30 == spark.read.parquet(f"{tmp_path}/outbox").count()


def test_delivering_once(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "delivery_id string, v int")
    assert pipelines.deliver_once(batch, f"{tmp_path}/t").count() == 2
    assert pipelines.deliver_once(batch.unionByName(spark.createDataFrame([("c", 3)], batch.schema)), f"{tmp_path}/t").count() == 1
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_captures_and_digests():
    c = folds.CaptureFold()
    c.apply({"op": "configure", "now_ms": 0, "id": "s", "interval_ms": 1_000})
    step = lambda now, **more: c.apply({"op": "maintain", "now_ms": now, "id": "s", "base_offset": 0, "end_offset": 9, **more})
    assert step(999)["error"] == "not_due" and c.due(1_000) == ["s"]
    assert step(3_500, pending_offset=4)["end_offset"] == 4 and c.schedules["s"]["next_at"] == 4_000
    late = step(4_000, base_offset=6)
    assert (late["first_offset"], late["end_offset"], late["skipped"]) == (6, 9, 2)
    for k in range(5, 50):
        step(k * 1_000)
    assert len(c.captures) == c.MAX
    one, two = folds.DigestFold(), folds.DigestFold()
    for k in range(3):
        assert one.apply({"a": k, "b": 1}) == two.apply({"b": 1, "a": k})


def test_webhooks(spark):
    df = spark.createDataFrame([(1_700_000_000, "d.1", 2, "é{}"), (1, "x", 1, "")], "ts long, id string, attempt int, body string")
    for secret in (b"k", b"x" * 100):
        for r in df.select("*", webhook.signature(secret, F.col("ts"), F.col("id"), F.col("attempt"), F.col("body")).alias("s")).collect():
            body = r.body.encode()
            text = f"v1\n{r.ts}\n{r.id}\n{r.attempt}\n{hashlib.sha256(body).hexdigest()}"
            assert r.s == hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()
            args = [secret, body, r.id, str(r.attempt), str(r.ts), f"v1={r.s}", r.ts + 300]
            assert webhook.verify(*args) == (r.id, r.attempt, r.ts)
            for k, bad in ((1, body + b"x"), (2, " "), (3, "0"), (4, f"0{r.ts}"), (5, f"v1={r.s.upper()}1"), (6, r.ts + 301)):
                with pytest.raises(ValueError):
                    webhook.verify(*args[:k], bad, *args[k + 1 :])
    statuses = spark.createDataFrame([(s,) for s in (200, 299, 301, 404, 429, 500, 503)], "s int")
    assert [r[0] for r in statuses.select(webhook.disposition(F.col("s"))).collect()] == ["acknowledge", "acknowledge", "reject", "reject", "retry", "retry", "retry"]
