"""Expressions, sketches and searches against fixed values and plain Python."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallystream.functions import hashes, matching, retry, sketches
from tallystream.operators import search


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_partitions(spark):
    known = [("customer-42", 14), ("order-1", 13), ("café", 9), ("東京", 15)]
    df = spark.createDataFrame([(k, k) for k, _ in known] + [("", "order-1"), (None, "order-1")], "key string, id string")
    found = [r[0] for r in df.select(hashes.partition_for(F.col("key"), F.col("id"), 16)).collect()]
    assert found == [p for _, p in known] + [13, 13]
    texts = ["", "x" * 300, "Ünïcode \U0001f600", "a\0b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[hashes.fnv1a_mod(F.col("t"), n) for n in (1, 7, 1 << 30, 2**31 - 1)]).collect()
    assert [tuple(r) for r in rows] == [tuple(fnv(t.encode()) % n for n in (1, 7, 1 << 30, 2**31 - 1)) for t in texts]


def test_digests(spark):
    r = spark.createDataFrame([("abc", "é")], "a string, b string").select(hashes.stable_hash(F.col("a")), hashes.proposal_id("d", F.col("a"), F.col("b")), hashes.bloom_positions(F.col("a"), 1024, 5)).first()
    d = hashlib.sha256(b"abc").digest()
    assert int(r[0]) == int.from_bytes(d[:8], "big")
    framed = b"d\0" + (3).to_bytes(8, "big") + b"abc" + (2).to_bytes(8, "big") + "é".encode()
    assert int(r[1]) == int.from_bytes(hashlib.sha256(framed).digest()[:8], "big")
    first, second = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
    assert r[2] == [(first + i * second) % 2**64 % 1024 for i in range(5)]


@pytest.mark.parametrize("policy", [retry.RetryPolicy(), retry.RetryPolicy(jitter_percent=0), retry.RetryPolicy(exponential=False), retry.RetryPolicy(3, 1_000_000, 37), retry.RetryPolicy(0, 0)])
def test_retry_delays(spark, policy):
    rows = [(i, a) for i in ("", "order-1", "é" * 20, "x" * 90) for a in (0, 1, 2, 5, 8, 64)]
    found = spark.createDataFrame(rows, "id string, attempt int").select("id", "attempt", retry.message_delay(F.col("id"), F.col("attempt"), policy), retry.delivery_delay(F.col("id"), F.col("attempt"), policy)).collect()
    for i, a, message, delivery in found:
        assert message == policy.message_delay(i, a)
        assert delivery == policy.delivery_delay(i, a)


def test_globs(spark):
    cases = [("order.*", "order.created", 1), ("*.created", "order.created", 1), ("order.???????", "order.created", 1), ("order.?", "order.✓", 1), ("payment.*", "order.created", 0), ("a*b?c", "a.x\nb✓c", 1), ("a[b]\\", "a[b]\\", 1), ("a[b]*", "ab", 0), ("*", "", 1), ("", "", 1), ("", "a", 0), ("A*", "a", 0), ("a**z", "az", 1)]
    for pattern, value, wanted in cases:
        df = spark.createDataFrame([(value,)], "v string")
        assert df.select(matching.glob_matches(F.col("v"), pattern)).first()[0] == bool(wanted), pattern
    bytes_ = spark.createDataFrame([("é",), ("x",), (None,)], "v string").select(matching.byte_glob_matches(F.col("v"), "?"), matching.byte_glob_matches(F.col("v"), "??"), matching.any_glob(F.col("v"), []), matching.any_glob(F.col("v"), ["*"])).collect()
    assert [tuple(r) for r in bytes_] == [(False, True, True, True), (True, False, True, True), (False, False, True, False)]


def test_json_equality(spark):
    payloads = ['{"order":{"total":42},"n":null}', '{"order":{"total":42.0}}', '{"order":[{"total":42}]}', "not json", None, '{"order":{"total":"42"}}', '{"order":{"total":{"b":1,"a":[2]}}}']
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    equal = lambda path, value: [r[0] for r in df.select(matching.json_equals(F.col("p"), path, value)).collect()]
    assert equal("order.total", "42") == [True, False, False, False, False, False, False]
    assert equal("$.order.total", "42.0") == [False, True, False, False, False, False, False]
    assert equal("order.total", '"42"') == [False, False, False, False, False, True, False]
    assert equal("order.total", '{"a":[2],"b":1}') == [False] * 6 + [True]
    assert equal("n", "null") == [True] + [False] * 6


def test_names(spark):
    df = spark.createDataFrame([("a.B-9_",), ("",), ("a b",), ("x" * 129,), (None,), (" \t",), ("a\x07",)], "v string")
    assert [tuple(r) for r in df.select(matching.valid_name(F.col("v")), matching.valid_identifier(F.col("v"))).collect()] == [(True, True), (False, False), (False, True), (False, True), (False, False), (False, False), (False, False)]


def test_cardinality(spark):
    values = [i.to_bytes(4, "big") for i in range(1000)]
    df = spark.createDataFrame([("g", bytearray(v)) for v in values], "g string, v binary")
    table = sketches.registers(df, F.col("v"), 10, ["g"])
    ranks = [0] * 1024
    for v in values:
        h = int.from_bytes(hashlib.sha256(v).digest()[:8], "big")
        ranks[h % 1024] = max(ranks[h % 1024], 54 - (h >> 10).bit_length() + 1)
    assert {r.register: r["rank"] for r in table.collect()} == {i: r for i, r in enumerate(ranks) if r}
    zeros = ranks.count(0)
    raw = 0.7213 / (1 + 1.079 / 1024) * 1024**2 / sum(2.0**-r for r in ranks)
    wanted = round(1024 * math.log(1024 / zeros)) if raw <= 2560 and zeros else round(raw)
    found = sketches.estimate(table, 10, ["g"]).first()["estimate"]
    assert found == wanted and 900 <= found <= 1100


def test_bitmaps(spark):
    df = spark.createDataFrame([("a", 65), ("a", 65), ("a", 0), ("a", 1_048_575), ("b", 32_768)], "g string, bit long")
    assert {r.g: r.bits_set for r in sketches.bitmap_counts(df, F.col("bit"), ["g"]).collect()} == {"a": 3, "b": 1}
    with pytest.raises(Exception, match="outside"):
        sketches.bitmap_counts(spark.createDataFrame([("a", 1_048_576)], "g string, bit long"), F.col("bit"), ["g"]).collect()


def test_bloom_and_cuckoo(spark):
    inside = spark.createDataFrame([("member",), ("other",)], "v string")
    bloom = sketches.bloom_filter(inside, F.col("v"), 1024, 5)
    probes = spark.createDataFrame([("member",), ("absent",), ("other",)], "v string")
    assert {r.v: r.maybe for r in sketches.bloom_contains(probes, F.col("v"), bloom, 1024, 5).collect()} == {"member": True, "absent": False, "other": True}
    with pytest.raises(ValueError):
        sketches.bloom_filter(inside, F.col("v"), 63, 5)
    cuckoo = sketches.CuckooFilter(32, 4)
    values = [str(i).encode() for i in range(100)]
    assert all(cuckoo.add(v) for v in values) and not cuckoo.add(values[0]) and all(cuckoo.contains(v) for v in values)
    assert cuckoo.delete(values[3]) and not cuckoo.contains(values[3]) and not cuckoo.delete(values[3])
    with pytest.raises(OverflowError):
        for i in range(1000):
            before = json.dumps(cuckoo.table)
            cuckoo.add(f"more{i}".encode())
    assert json.dumps(cuckoo.table) == before


def test_searches(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0, 0.0], "Red fox"), ("a", [1.0, 0.0, 0.0], "red FOX!"), ("c", [0.0, 1.0, 0.0], ""), ("z", [0.0, 0.0, 0.0], "x")], "id string, vector array<float>, text string")
    assert [(r.id, r.score) for r in search.vector_search(rows, [1, 0, 0], 3, "fox red", 0.5).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    points = spark.createDataFrame([("kolkata", 88_363_900, 22_572_600), ("nearby", 88_364_000, 22_572_700), ("far", 77_000_000, 28_000_000)], "member string, lon int, lat int")
    assert [r.member for r in search.geo_radius(points, 88.3639, 22.5726, 100, 10).collect()] == ["kolkata", "nearby"]
    docs = spark.createDataFrame([("b", '{"t":"north"}'), ("a", '{"t":"north"}'), ("c", '{"t":1}')], "id string, payload string")
    assert [r.id for r in search.json_exact(docs, "t", '"north"').collect()] == ["a", "b"]
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            search.vector_search(rows, [1, 0, 0], limit)


def test_json_pointers(spark):
    doc = {"a": {"b/c": [1, {"~": 2}]}, "s": 5}
    assert search.pointer_get(doc, "/a/b~1c/1/~0") == 2 and search.pointer_get(doc, "") == doc
    for bad in ("/a/b~1c/01", "/a/b~1c/2", "/x"):
        with pytest.raises(KeyError):
            search.pointer_get(doc, bad)
    assert search.pointer_set({"s": 5}, "/s/x/y", 1) == {"s": {"x": {"y": 1}}}
    assert search.pointer_remove({"a": {"b": 1}}, "/a/b") == ({"a": {}}, True) and search.pointer_remove([1], "/0") == ([1], False)
    df = spark.createDataFrame([('{"b":42.0,"a":1}',), (None,), ("bad",)], "payload string")
    assert [r.edited for r in search.edited(df, "set", "/c", "[1]").collect()] == ['{"a":1,"b":42.0,"c":[1]}', '{"c":[1]}', None]
    deep = "[" * 70 + "]" * 70
    assert search.edited(spark.createDataFrame([(deep,)], "payload string"), "remove", "/x").first().edited is None


def test_cosine_matches_python(spark):
    r = random.Random(1)
    vectors = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(20)]
    probe = vectors[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, v array<double>")
    for i, c in df.select("id", matching.cosine(F.col("v"), probe)).collect():
        v = vectors[i]
        assert math.isclose(c, sum(a * b for a, b in zip(v, probe, strict=True)) / math.hypot(*v) / math.hypot(*probe), rel_tol=1e-12)
