"""State machines: fixed examples, random checks against closed forms, and streams against batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallystream.functions.retry import RetryPolicy
from tallystream.streaming import drivers, folds


def plain(**more):
    return RetryPolicy(jitter_percent=0, **more)


def run(fold, *commands):
    """Answers of commands given as (op, now, fields)."""
    return [fold.apply({"op": op, "now_ms": now, **fields}) for op, now, fields in commands]


def token(answer, k=0):
    return answer["leased"][k]["token"]


def test_queue_lifecycle():
    q = folds.QueueFold(folds.QueueConfig(visibility_ms=30, retry=plain(initial_delay_ms=10, max_attempts=2)))
    run(q, ("enqueue", 0, {"id": "a"}), ("enqueue", 1, {"id": "b", "priority": 5}), ("enqueue", 1, {"id": "c", "deliver_at_ms": 100}))
    first = q.apply({"op": "acquire", "now_ms": 2, "consumer": "x", "max": 5})
    assert [m["id"] for m in first["leased"]] == ["b", "a"]
    assert q.apply({"op": "ack", "now_ms": 3, "token": token(first)})["ok"]
    assert q.apply({"op": "ack", "now_ms": 3, "token": token(first)}) == {"ok": False, "error": "fenced"}
    assert q.apply({"op": "nack", "now_ms": 4, "token": token(first, 1), "reason": " "})["error"] == "invalid_argument"
    assert q.apply({"op": "nack", "now_ms": 4, "token": token(first, 1), "reason": "r"})["eligible_at_ms"] == 14
    assert q.apply({"op": "acquire", "now_ms": 13, "consumer": "x"})["leased"] == []
    again = q.apply({"op": "acquire", "now_ms": 14, "consumer": "x"})
    assert again["leased"][0]["attempt"] == 2
    q.apply({"op": "maintain", "now_ms": 44})  # the lease is over, and so are the attempts
    assert q.messages["a"]["state"] == "dead_lettered" and q.messages["a"]["reason"] == "visibility_timeout"
    assert q.apply({"op": "enqueue", "now_ms": 45, "id": "a"})["error"] == "already_exists"
    assert q.apply({"op": "redrive", "now_ms": 50, "id": "a"})["ok"]
    assert q.apply({"op": "redrive", "now_ms": 50, "id": "a"})["error"] == "not_found"
    last = q.apply({"op": "acquire", "now_ms": 101, "consumer": "x", "max": 5})
    assert [m["id"] for m in last["leased"]] == ["c", "a"]


def test_queue_expiry_and_dedupe():
    q = folds.QueueFold(folds.QueueConfig(visibility_ms=30, max_messages=1, dedupe_window_ms=100, overflow="drop_oldest", retry=plain()))
    one = q.apply({"op": "enqueue", "now_ms": 0, "id": "a", "dedupe_id": "d", "ttl_ms": 500})
    assert q.apply({"op": "enqueue", "now_ms": 99, "id": "b", "dedupe_id": "d"}) == {"ok": True, "id": "a", "duplicate": True} and one["duplicate"] is False
    assert q.apply({"op": "enqueue", "now_ms": 100, "id": "b", "dedupe_id": "d"})["duplicate"] is False
    assert q.messages["a"]["state"] == "expired" and q.active == 1
    strict = folds.QueueFold(folds.QueueConfig(max_messages=1))
    assert [r["ok"] for r in run(strict, ("enqueue", 0, {"id": "a"}), ("enqueue", 0, {"id": "b"}))] == [True, False]
    letters = folds.QueueFold(folds.QueueConfig(max_active_bytes=10, overflow="dead_letter_oldest"))
    run(letters, ("enqueue", 0, {"id": "a", "bytes": 6}), ("enqueue", 0, {"id": "b", "bytes": 6}))
    assert letters.messages["a"]["state"] == "dead_lettered" and letters.active_bytes == 6
    short = folds.QueueFold(folds.QueueConfig(visibility_ms=30))
    run(short, ("enqueue", 0, {"id": "a", "ttl_ms": 10}))
    assert short.apply({"op": "acquire", "now_ms": 5, "consumer": "x"})["leased"][0]["deadline_ms"] == 10
    short.apply({"op": "maintain", "now_ms": 10})
    assert short.messages["a"]["state"] == "expired"


def test_queue_aging_sessions_and_deferral():
    q = folds.QueueFold(folds.QueueConfig(visibility_ms=30, aging_ms=10))
    run(q, ("enqueue", 0, {"id": "old-low"}), ("enqueue", 19, {"id": "new-high", "priority": 2}))
    assert q.apply({"op": "acquire", "now_ms": 20, "consumer": "x"})["leased"][0]["id"] == "old-low"
    s = folds.QueueFold(folds.QueueConfig(visibility_ms=30))
    run(s, *[("enqueue", n, {"id": f"s{n}", "session_id": "s"}) for n in range(3)])
    assert s.apply({"op": "acquire", "now_ms": 5, "consumer": "x"})["leased"] == []
    held = s.apply({"op": "acquire_session", "now_ms": 5, "consumer": "x", "session_id": "s"})
    assert held["leased"][0]["id"] == "s0"
    assert s.apply({"op": "acquire_session", "now_ms": 6, "consumer": "y", "session_id": "s"})["error"] == "conflict"
    renewed = s.apply({"op": "renew_session", "now_ms": 7, "consumer": "x", "session_id": "s", "lock_token": held["lock_token"]})
    assert renewed["lock_deadline_ms"] == 37
    assert s.apply({"op": "defer", "now_ms": 8, "token": token(held), "consumer": "x"})["ok"]
    more = s.apply({"op": "acquire_session", "now_ms": 9, "consumer": "x", "session_id": "s", "lock_token": renewed["lock_token"], "max": 9})
    assert [m["id"] for m in more["leased"]] == ["s1", "s2"]
    assert s.apply({"op": "receive_deferred", "now_ms": 9, "consumer": "x", "id": "s0"})["leased"][0]["attempt"] == 2
    assert s.apply({"op": "release_session", "now_ms": 40, "consumer": "x", "session_id": "s", "lock_token": renewed["lock_token"]})["error"] == "fenced"


def test_bucket_and_breaker():
    q = folds.QueueFold(folds.QueueConfig(visibility_ms=30, retry=plain(initial_delay_ms=1), dispatch=folds.Dispatch(1, 1, 2, 1, 10)))
    run(q, ("enqueue", 0, {"id": "a"}), ("enqueue", 0, {"id": "b"}))
    first = q.apply({"op": "acquire", "now_ms": 0, "consumer": "x", "max": 2})
    assert len(first["leased"]) == 1
    q.apply({"op": "nack", "now_ms": 1, "token": token(first), "reason": "r"})
    assert q.apply({"op": "acquire", "now_ms": 10, "consumer": "x"})["leased"] == []
    assert len(q.apply({"op": "acquire", "now_ms": 11, "consumer": "x", "max": 2})["leased"]) == 1
    assert q.apply({"op": "acquire", "now_ms": 12, "consumer": "x"})["leased"] == []


def test_credit_terms_and_idleness():
    q = folds.QueueFold(folds.QueueConfig(idle_ms=50))
    run(q, *[("enqueue", 0, {"id": str(n)}) for n in range(5)])
    assert len(q.apply({"op": "acquire", "now_ms": 1, "consumer": "x", "max": 9, "credit": 2, "consumer_term": 3})["leased"]) == 2
    assert q.apply({"op": "acquire", "now_ms": 1, "consumer": "x", "max": 9, "credit": 2})["leased"] == []
    assert q.apply({"op": "acquire", "now_ms": 1, "consumer": "x", "consumer_term": 2})["error"] == "fenced"
    idle = folds.QueueFold(folds.QueueConfig(idle_ms=50))
    got = run(idle, ("enqueue", 0, {"id": "a"}), ("acquire", 1, {"consumer": "x"}))[1]
    run(idle, ("ack", 2, {"token": token(got)}), ("maintain", 52, {}))
    assert idle.expired and idle.apply({"op": "enqueue", "now_ms": 53, "id": "b"})["error"] == "queue_expired"


def test_ready_order_is_the_closed_form():
    r = random.Random(2)
    for _ in range(30):
        q = folds.QueueFold(folds.QueueConfig(max_messages=1000))
        rows = [(f"m{n}", r.randrange(10)) for n in range(40)]
        for i, p in rows:
            q.apply({"op": "enqueue", "now_ms": 0, "id": i, "priority": p})
        got = [m["id"] for _ in range(8) for m in q.apply({"op": "acquire", "now_ms": 1, "consumer": "x", "max": 5})["leased"]]
        assert got == [rows[k][0] for k in sorted(range(40), key=lambda k: (-rows[k][1], k))]


def test_delivery_ledger():
    d = folds.DeliveryFold(plain(initial_delay_ms=10, max_attempts=2), max_in_flight=2, timeout_ms=30)
    run(d, *[("publish", p, {"position": p, "subscriptions": ["s"]}) for p in range(4)])
    got = d.apply({"op": "acquire", "now_ms": 5, "subscription": "s", "dispatcher": "x", "max": 9})
    assert [m["id"][-3:] for m in got["leased"]] == ["0.s", "1.s"]
    assert d.apply({"op": "ack", "now_ms": 6, "id": got["leased"][0]["id"], "dispatcher": "y", "token": token(got)})["error"] == "fenced"
    assert d.apply({"op": "ack", "now_ms": 6, "id": got["leased"][0]["id"], "dispatcher": "x", "token": token(got)})["ok"]
    failed = d.apply({"op": "fail", "now_ms": 6, "id": got["leased"][1]["id"], "dispatcher": "x", "token": token(got, 1), "reason": "r"})
    assert failed["retry_at_ms"] == 16
    more = d.apply({"op": "acquire", "now_ms": 16, "subscription": "s", "dispatcher": "x", "max": 9})
    assert [m["id"][-3:] for m in more["leased"]] == ["1.s", "2.s"]
    assert d.apply({"op": "maintain", "now_ms": 46}) == {"ok": True, "retried": 1, "dead_lettered": 1}
    assert d.counts() == {"pending": 2, "in_flight": 0, "acknowledged": 1, "dead_lettered": 1}
    d.apply({"op": "publish", "now_ms": 50, "position": 9, "subscriptions": {"t": "queue:q"}})
    assert d.apply({"op": "acquire", "now_ms": 60, "subscription": "t", "dispatcher": "x"})["leased"] == []
    assert d.apply({"op": "publish", "now_ms": 50, "position": 9, "subscriptions": ["t"]})["error"] == "duplicate"


def test_sessions():
    s = folds.SessionFold(5)
    got = run(s, ("join", 0, {"member": "b", "timeout_ms": 1_000}), ("join", 1, {"member": "a", "timeout_ms": 2_000}))
    assert [g["generation"] for g in got] == [1, 2] and s.assignments() == {"a": [0, 2, 4], "b": [1, 3]}
    assert s.apply({"op": "heartbeat", "now_ms": 5, "member": "b", "generation": 1})["error"] == "stale_generation"
    assert s.apply({"op": "heartbeat", "now_ms": 500, "member": "b", "generation": 2})["deadline_ms"] == 1_500
    late = s.apply({"op": "maintain", "now_ms": 1_500})
    assert late["expired"] == ["b"] and late["generation"] == 3
    assert s.apply({"op": "maintain", "now_ms": 100})["generation"] == 3 and s.watermark == 1_500
    assert s.apply({"op": "leave", "now_ms": 1_600, "member": "a", "generation": 3})["generation"] == 4


def test_producers_and_transactions():
    p = folds.ProducerFold()
    put = lambda seq, digest="d", term=1, **more: p.apply({"op": "append", "now_ms": 0, "producer": "p", "term": term, "sequence": seq, "digest": digest, **more})
    assert put(0)["offsets"] == [0] and put(1, records=3)["offsets"] == [1, 2, 3]
    assert put(1)["disposition"] == "duplicate" and put(1, "other")["error"] == "conflict" and put(5)["error"] == "sequence_gap"
    assert p.apply({"op": "begin", "now_ms": 0, "producer": "p", "term": 1, "transaction_id": "t"})["status"] == "pending"
    assert put(2, transaction_id="t")["ok"] and put(3, records=128, transaction_id="t")["error"] == "capacity"
    assert put(0, term=2)["disposition"] == "new" and p.transactions["t"]["status"] == "aborted"
    assert put(9, term=1)["error"] == "fenced"
    end = lambda op, tx, term=2: p.apply({"op": op, "now_ms": 0, "producer": "p", "term": term, "transaction_id": tx})
    assert end("begin", "u")["ok"] and end("commit", "u")["replayed"] is False and end("commit", "u")["replayed"] is True and end("abort", "u")["error"] == "committed"
    for n in range(1, 300):
        put(n, term=2)
    assert put(43, term=2)["error"] == "history_expired" and put(44, term=2)["disposition"] == "duplicate"


def test_offsets():
    o = folds.OffsetFold({"0": [5, 9]})
    move = lambda op, offset, **more: o.apply({"op": op, "now_ms": 0, "partition": 0, "offset": offset, **more})
    assert move("commit", 6)["lag"] == 3 and move("commit", 5)["error"] == "invalid_offset" and move("reset", 5)["ok"] and move("commit", 10)["error"] == "invalid_offset"
    o.apply({"op": "claim", "now_ms": 0, "member": "m", "generation": 2})
    assert move("commit", 7)["error"] == "fenced" and move("commit", 7, member="m", generation=2)["ok"]
    assert o.apply({"op": "claim", "now_ms": 0, "member": "n", "generation": 2})["error"] == "stale_generation" and o.offsets == {"0": 7}


def transact(fold, now, *ops, **more):
    return fold.apply({"op": "transact", "now_ms": now, "operations": list(ops), **more})


def test_cache_transactions():
    c = folds.CacheFold(folds.CacheConfig(max_entries=2, policy="all_keys_lru"))
    assert transact(c, 0, {"op": "set", "key": "a", "value": 1}, {"op": "increment", "key": "n", "delta": 5})["results"] == [None, 5]
    assert transact(c, 1, {"op": "set", "key": "a", "value": 2, "condition": "absent"}, {"op": "increment", "key": "n"})["error"] == "conflict" and c.entries["n"]["value"] == 5
    assert transact(c, 1, {"op": "delete", "key": "zz"})["revision"] == 1
    assert transact(c, 1, {"op": "list_push", "key": "a", "value": 1})["error"] == "wrong_type"
    transact(c, 2, {"op": "access", "key": "a"})
    assert transact(c, 3, {"op": "set", "key": "b", "value": 3})["evicted"] == ["n"]
    assert transact(c, 3, {"op": "set", "key": "b", "value": 3}, expected_revision=1)["error"] == "conflict"
    assert transact(c, 3, {"op": "set", "key": "b", "value": 3}, {"op": "set", "key": "b", "value": 4})["error"] == "invalid_argument"
    big = folds.CacheFold()
    transact(big, 0, {"op": "set", "key": "n", "value": 0, "kind": "counter"})
    assert transact(big, 0, {"op": "increment", "key": "n", "delta": 2**63})["error"] == "overflow"


def test_cache_collections_and_expiry():
    c = folds.CacheFold(folds.CacheConfig(default_ttl_ms=100))
    transact(c, 0, {"op": "hash_put", "key": "h", "field": "f", "value": 1}, {"op": "set_add", "key": "s", "member": "m"}, {"op": "list_push", "key": "l", "value": 1}, {"op": "sorted_set_add", "key": "z", "member": "m", "score": 2})
    transact(c, 1, {"op": "list_push", "key": "l", "value": 0, "side": "front"}, {"op": "set_add", "key": "s", "member": "a"}, {"op": "hash_remove", "key": "h", "field": "f"}, {"op": "sorted_set_add", "key": "z", "member": "m", "score": 3})
    assert {k: e["value"] for k, e in c.entries.items()} == {"h": {}, "s": ["a", "m"], "l": [0, 1], "z": {"m": 3.0}}
    assert transact(c, 2, {"op": "list_pop", "key": "l"})["results"] == [1]
    assert transact(c, 99, {"op": "access", "key": "l"})["results"] == [[0]] and transact(c, 100, {"op": "access", "key": "l"})["results"] == [None]
    assert transact(c, 99, {"op": "set", "key": "x", "value": 1, "ttl_ms": 0})["error"] == "invalid_argument"
    assert c.apply({"op": "sweep", "now_ms": 100, "max": 2})["removed"] == ["h", "l"]


def test_cache_history_and_restore():
    r = random.Random(9)
    for history in (5, 1_024):
        c, states = folds.CacheFold(folds.CacheConfig(history=history)), {0: {}}
        for now in range(60):
            key = f"k{r.randrange(5)}"
            transact(c, now, {"op": "delete", "key": key} if r.random() < 0.3 else {"op": "set", "key": key, "value": now}, {"op": "set", "key": "both", "value": now})
            states[c.revision] = {k: e["value"] for k, e in c.entries.items()}
        reached = [v for v in states if v >= c.changes[0]["revision"] - 1]
        assert len(reached) < len(states) or history > 60
        for v in reached:
            assert {k: e["value"] for k, e in c.at(v).items()} == states[v]
        with pytest.raises(folds.Refused):
            c.at(min(reached) - 1)
        assert c.apply({"op": "restore", "now_ms": 99, "revision": reached[0]})["ok"]
        assert {k: e["value"] for k, e in c.entries.items()} == states[reached[0]]


def test_entries_with_their_own_versions():
    k = folds.KeyValueFold(folds.CacheConfig(max_entries=2, policy="all_keys_lru"))
    put = lambda now, key, **more: k.apply({"op": "set", "now_ms": now, "key": key, "value": 1, **more})
    do = lambda op, now, key, **more: k.apply({"op": op, "now_ms": now, "key": key, **more})
    assert put(0, "a")["version"] == 1 and put(1, "a")["version"] == 2 and put(1, "a", condition="absent")["error"] == "conflict"
    assert put(1, "z", condition="present")["error"] == "not_found" and put(1, "a", expected_version=1)["error"] == "conflict" and put(1, "a", expected_version=2)["version"] == 3
    assert do("increment", 2, "n", delta=5)["value"] == 5 and do("increment", 2, "a")["error"] == "conflict"
    do("get", 9, "a")
    assert put(10, "c", ttl_ms=0)["ok"] and "n" not in k.entries  # the least seen leaves
    assert do("get", 10, "c") == {"ok": True, "found": False} and do("expire", 10, "c", ttl_ms=5)["error"] == "not_found"
    assert do("list_push", 11, "l", value=1)["length"] == 1 and k.entries["l"]["version"] == 2
    assert do("expire", 12, "l", ttl_ms=3)["version"] == 3 and do("delete", 99, "l")["deleted"] is True
    assert [e["kind"] for e in k.events] == ["set", "set", "set", "set", "evict", "set", "expire", "set", "delete"]
    put(20, "t", ttl_ms=1)
    assert k.apply({"op": "purge", "now_ms": 30})["purged"] == ["t"]
    assert folds.KeyValueFold(k.config).load(k.dump()).dump() == k.dump()


def test_observation():
    q = folds.QueueFold()
    run(q, ("enqueue", 0, {"id": "a", "bytes": 3}), ("enqueue", 0, {"id": "b", "deliver_at_ms": 9}))
    assert {k: v for k, v in q.observation().items() if v} == {"ready": 1, "scheduled": 1, "active": 2, "active_bytes": 3, "circuit": "closed"}


def test_locks_registry_and_forwards():
    k = folds.LockFold()
    take = {"op": "acquire", "lock": "l", "owner": "a", "owner_term": 2, "lease_ms": 10}
    held = k.apply({**take, "now_ms": 0})
    assert held["fencing_token"] == 1 and k.apply({**take, "now_ms": 5, "owner": "b"})["error"] == "conflict"
    assert k.apply({**take, "now_ms": 5, "lock": "m", "owner_term": 1})["error"] == "fenced"
    renewed = k.apply({"op": "renew", "now_ms": 6, "lock": "l", "owner": "a", "owner_term": 2, "token": held["token"], "lease_ms": 10})
    assert renewed["fencing_token"] == 1 and k.apply({"op": "release", "now_ms": 7, "lock": "l", "owner": "a", "owner_term": 2, "token": held["token"]})["error"] == "fenced"
    assert k.apply({**take, "now_ms": 16, "owner": "b"})["fencing_token"] > 1
    g = folds.RegistryFold()
    put = {"op": "apply", "name": "n", "spec": {"x": 1}, "token": "t1"}
    assert g.apply(put) == {"ok": True, "generation": 1, "changed": True} and g.apply(put)["replayed"] is True
    assert g.apply({**put, "spec": {"x": 2}})["error"] == "token_reused" and g.apply({**put, "token": "t2"})["changed"] is False
    assert g.apply({"op": "delete", "name": "n", "expected_generation": 7})["error"] == "conflict" and g.apply({"op": "delete", "name": "n"})["ok"]
    assert g.apply({**put, "token": "t3"})["generation"] == 2
    f = folds.ForwardFold()
    steps = [f.apply({"op": op, "id": "a", "destination": d}) for op, d in (("bind", "q"), ("note", None), ("bind", "q"), ("bind", "r"), ("complete", "q"), ("complete", "q"))]
    assert [s["ok"] for s in steps] == [False, True, True, False, True, True]


def random_log(shards, n, seed=1):
    r = random.Random(seed)
    ops = lambda k: r.choice([{"op": "enqueue", "id": f"m{k}", "priority": r.randrange(10), "dedupe_id": r.choice([None, "d1", "d2"])}, {"op": "acquire", "consumer": "c", "max": 2}, {"op": "maintain"}, {"op": "redrive", "id": f"m{r.randrange(max(k, 1))}"}])
    return [(f"s{r.randrange(shards)}", k, json.dumps({**ops(k), "now_ms": 10 * k})) for k in range(n)]


def test_batch_and_stream_agree(spark, tmp_path):
    def make():  # of the test's own, as workers can't import this module
        return folds.QueueFold(folds.QueueConfig(visibility_ms=40, dedupe_window_ms=100, retry=RetryPolicy(max_attempts=2, initial_delay_ms=5)))

    rows = random_log(3, 240)
    log = spark.createDataFrame(rows, "shard string, seq long, command string").repartition(4)
    batch = sorted(map(tuple, drivers.run_batch(log, make).collect()))
    alone = {}
    want = [(s, n, *((a := alone.setdefault(s, make()).apply(json.loads(c)))["ok"], a.get("error"))) for s, n, c in rows]
    assert [b[:4] for b in batch] == sorted(want)
    assert {r.shard: r.state for r in drivers.final_states(log, make).collect()} == {s: f.dump() for s, f in alone.items()}
    answers = []
    for part in range(4):  # the stream is stopped and started again between the parts
        spark.createDataFrame(rows[part * 60 : part * 60 + 60], "shard string, seq long, command string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        source = spark.readStream.schema("shard string, seq long, command string").parquet(f"{tmp_path}/log")
        query = drivers.run_stream(source, make).writeStream.outputMode("append").foreachBatch(lambda df, _: answers.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(answers) == batch
    assert drivers.run_batch(log.filter(F.lit(False)), make).collect() == []


@pytest.mark.parametrize("per_bucket", [None, 11, 1 << 20])
def test_offset_commits_are_those_of_the_fold(spark, per_bucket):
    from pyspark.sql import functions as F

    from tallystream.operators import stream

    r = random.Random(8)
    commands = [(r.randrange(2), r.randrange(3), n, r.choice(["commit", "commit", "reset"]), r.randrange(14)) for n in range(300)]
    limits = {"0": [2, 11], "1": [0, 13]}
    table = spark.createDataFrame(commands, "group long, partition long, seq long, op string, offset long")
    known = spark.createDataFrame([(int(p), *x) for p, x in limits.items()], "partition long, base_offset long, end_offset long")
    found = {x.seq: x.accepted for x in stream.commits(table, known, per_bucket).select("seq", F.col("accepted")).collect()}
    groups = {g: folds.OffsetFold(limits) for g in (0, 1)}
    for g, p, n, op, offset in commands:
        assert found[n] == groups[g].apply({"op": op, "now_ms": 0, "partition": p, "offset": offset})["ok"], n
    lost = spark.createDataFrame([(None, 0, 1, "commit", 5), (0, None, 2, "reset", 5), (0, 9, 3, "commit", 5), (0, 0, 4, None, 5)], table.schema)
    assert {x.seq: x.accepted for x in stream.commits(lost, known, per_bucket).collect()} == {1: False, 2: False, 3: False, 4: True}
