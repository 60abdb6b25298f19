"""The byte n-gram model of the quality operator."""

import collections
import math
import random

import cases
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallystream.llm import ngrams, quality, queries


def brute(texts):
    """The probability of each byte after the bytes before it, counted in dictionaries."""
    n = ngrams.ORDER
    counts = {n: collections.Counter()}
    for t in texts:
        raw = b"\n" * (n - 1) + t.encode()
        counts[n].update(raw[i : i + n] for i in range(len(raw) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    less = {}
    for k in counts:
        one, two, three, four = (sum(c == m for c in counts[k].values()) for m in range(1, 5))
        y = one / (one + 2 * two)
        raw = [1 - 2 * y * two / one, 2 - 3 * y * three / two if two else 0.5, 3 - 4 * y * four / three if three else 0.5]
        less[k] = [min(max(d, 0.1), m + 0.9) if (one, two, three)[m] else 0.5 for m, d in enumerate(raw)]
    follow = {k: collections.defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            follow[k][g[:-1]].append(c)

    def p(gram):
        if not gram:
            return 1 / 256
        k, lower = len(gram), p(gram[1:])
        after = follow[k].get(gram[:-1])
        if not after:
            return lower
        d = lambda c: less[k][min(c, 3) - 1] if c else 0
        c = counts[k][gram]
        return (c - d(c) + sum(map(d, after)) * lower) / sum(after)

    def perplexity(text):
        raw = b"\n" * (n - 1) + text.encode()
        return math.exp(-np.mean([math.log(p(raw[i : i + n])) for i in range(len(raw) - n + 1)]))

    some = next(iter(counts[n]))[:-1]
    assert abs(sum(p(some + bytes([b])) for b in range(256)) - 1) < 1e-9
    return counts, perplexity


def invented(n, seed=5):
    r = random.Random(seed)
    words = ["The", "Rain", "in", "Spain", "falls", "on", "1984", "2001", "plains", "und", "Über", "привет", "мир", "東京"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(20, 50))) for _ in range(n)]


def stored(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_windows(monkeypatch):
    for limit in (1 << 21, 3):
        monkeypatch.setattr(ngrams, "WINDOW", limit)
        for texts in (["abcdé fgh"], ["ab", None, "", "cdefgh"], [""], []):
            found = [(int(o), int(g)) for grams, owner in ngrams.windows(pa.array(texts, pa.string())) for g, o in zip(grams, owner, strict=True)]
            padded = [b"\n" * 4 + (t or "").encode() for t in texts]
            assert found == [(i, int.from_bytes(t[j : j + 5], "big")) for i, t in enumerate(padded) for j in range(len(t) - 4)]


def test_perplexity_is_that_of_counted_ngrams(spark, tmp_path, monkeypatch):
    texts = invented(60)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, t, None) for i, (_, t, *_) in enumerate(cases.awkward())]
    docs = stored(spark, str(tmp_path / "docs"), rows)
    good = docs.filter("doc_id < 40").select("doc_id")
    counts, perplexity = brute(texts[:40])
    found = quality.assess(docs, good).collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert r.n_bytes == len((text or "").encode()) and (r.perplexity is None) == (not text)
        assert not text or abs(r.perplexity / perplexity(text) - 1) < 1e-3
    table = ngrams.model(docs.filter("doc_id < 40").select("text"))
    assert {r.key for r in table.filter("num > 0").select("key").collect()} == {ngrams.key(k, int.from_bytes(g, "big")) for k in counts for g in counts[k]}
    for name, value in (("CHUNK_BYTES", 5_000), ("WINDOW", 700), ("HELD", 50)):
        monkeypatch.setattr(ngrams, name, value)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 1)
    assert sorted(map(str, quality.assess(docs, good).collect())) == sorted(map(str, found))
    assert quality.assess(docs.limit(0), good).collect() == []
    assert all(r.kept == (r.n_bytes > 0) for r in quality.assess(docs, good.limit(0)).collect())


def test_bytes_that_share_a_class_are_told_apart(spark, tmp_path):
    """Other capitals, digits and letters beyond ASCII: a model of byte classes scores these as the original."""
    texts = invented(80)
    swapped = texts[60].translate(str.maketrans({"T": "Q", "R": "X", "S": "Z", "1": "7", "9": "3", "0": "6", "п": "ш", "р": "с", "东": "東"}))
    stored(spark, str(tmp_path / "documents.parquet"), [(i, t, "en") for i, t in enumerate(texts)] + [(100, swapped, "en")])
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r.doc_id: r for r in queries.op9_quality(spark, str(tmp_path)).collect()}
    assert found[100].perplexity > 1.2 * found[60].perplexity and not found[100].kept


def test_model_grows_with_the_trusted_text(spark, tmp_path):
    r = random.Random(1)
    docs = stored(spark, str(tmp_path / "docs"), [(i, "".join(chr(r.randrange(33, 0x3000)) for _ in range(500)), "en") for i in range(300)])
    few, many = (ngrams.model(docs.filter(F.col("doc_id") < n).select("text")).count() for n in (30, 300))
    assert many > 5 * few and many > 64**3


def test_low_labels_choose_the_quantile(spark):
    """Low-quality rows inside the trusted range: the 0.995 quantile keeps them, the one they choose doesn't."""
    rows = [(i, x, True, 9, float(i % 1000 + 1)) for x, start in (("en", 0), ("de", 1000), ("fr", 2000)) for i in range(start, start + 1000)]
    rows += [(5000 + i, "en", False, 9, 983.0 + i) for i in range(10)] + [(6000 + i, "de", False, 9, 5000.0) for i in range(10)] + [(7000, "fr", False, 9, 990.0)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, trusted boolean, n_bytes long, perplexity double")
    low = spark.createDataFrame([(i,) for i, *_ in rows if 5000 <= i < 7000], "bad long")
    found = {r.doc_id: r for r in quality._decided(scored, 0.995, low).collect()}
    assert len(found) == len(rows) and not any(r.kept for i, r in found.items() if 5000 <= i < 7000)
    assert [found[i].limit for i in (0, 1000, 2000)] == [980.0, 995.0, 995.0] and found[7000].kept
    assert sum(r.kept for r in quality._decided(scored, 0.995).collect() if r.doc_id < 6000 and r.doc_id >= 5000) == 10
