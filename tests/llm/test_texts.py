"""Token, language, toxicity, personal-data, quality and secret operators."""

import collections
import hashlib
import json
import random
import re

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystream.llm import _filter, bpe, language, pii, secrets, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 1\n\t'!é東"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_tokens_are_the_librarys(coder, text):
    ids = coder.encoding.encode_ordinary(text)
    old = bpe.CHUNK, bpe.LONG_MATCH
    assert coder.encode(text) == ids and coder.decode(ids) == text.encode()
    assert [i for c in bpe.safe_chunks(text, 5) for i in coder.encoding.encode_ordinary(c)] == ids
    assert bpe.heap_merge(text.encode(), coder.ranks) == coder.encoding._core_bpe.encode_single_piece(text.encode()) if text else True
    assert old == (bpe.CHUNK, bpe.LONG_MATCH)


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 4000, "é" * 3000, "word  tail\n\n " * 9000, " " * 5000, "y" * 600 + "   z" * 50, "1" * 3000 + "!" * 3000])
def test_long_texts(coder, text):
    assert coder.encode(text) == coder.encoding.encode_ordinary(text)


def test_round_trip(spark, coder):
    rows = bpe.round_trip(cases.frame(spark), RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text")).collect()
    assert len(rows) == len(cases.awkward()) and all(r.lossless for r in rows)
    for r in rows:
        ids = coder.encoding.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    encoded = bpe.encode_texts(cases.frame(spark), RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert collections.Counter(bytes(r.decoded) for r in decoded) == collections.Counter((r[1] or "").encode() for r in cases.awkward())


def test_gru_gradients():
    net = language.ByteGru(["a", "b", "c"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    r = np.random.default_rng(0)
    x, mask, gold = r.integers(97, 110, (4, 9)).astype(np.uint8), np.arange(9) < np.array([[9], [5], [9], [1]]), np.array([0, 1, 2, 0])

    def loss():
        p = net.position_probabilities(x).astype(float)
        return -(np.log(p[:, np.arange(4), gold]) * mask.T).sum() / mask.sum()

    grad = net.gradients(x, mask, gold)
    for name, w in net.weights.items():
        flat = w.reshape(-1)
        for k in r.choice(np.flatnonzero(np.abs(grad[name].reshape(-1)) > 1e-3), 4):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - grad[name].reshape(-1)[k]) < 5e-3


def invented(seed=0, n=120):
    r = random.Random(seed)
    parts = {"en": ["the", "tion", "and", "ing"], "de": ["der", "ung", "sch", "ich"], "fr": ["eau", "que", "oi", "é"]}
    return [(i, " ".join("".join(r.choices(parts[x], k=r.randrange(1, 4))) for _ in range(r.randrange(20, 60))), x) for i in range(n) for x in [r.choice(list(parts))]]


def test_language(spark):
    rows = invented()
    docs = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    net = language.fit(docs.filter("doc_id % 4 <> 1"))
    found = language.identify(docs, net).collect()
    truth = {i: x for i, _, x in rows}
    held = [r for r in found if r.doc_id % 4 == 1]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    odd = language.identify(cases.frame(spark), net, keep=("doc_id", "text")).collect()
    assert len(odd) == len(cases.awkward())
    for r in odd:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1
    by = collections.defaultdict(set)
    for r in odd:
        by[r.text].add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by.values())
    none = language.fit(docs.limit(0))
    assert {r.score for r in language.identify(cases.frame(spark), none).collect()} <= {0.0, 1.0}
    assert language.identify(cases.frame(spark, []), net).collect() == []


def test_language_sample_is_bounded_and_stands_clashes(spark):
    rows = [(k % 9, f"wort {k} und noch mehr", "de", 5, "x", 3) for k in range(300)] + [(100 + k % 9, f"word {k} and more", "en", 5, "x", 3) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, label string, wanted int")
    sample = language.training_sample(docs, "text", "lang", "doc_id", F.col("id") % 4 != 2, 160, 1000)
    assert len(sample) == sum(i % 4 != 2 for i in {r[0] for r in rows}) and {x for _, x in sample} == {"de", "en"}
    net = language.fit(docs, usable=F.col("id") % 4 != 2, max_chars=200)
    assert len(language.identify(docs, net, keep=("doc_id", "id", "label")).collect()) == 600


def test_pooled_probabilities_are_those_of_a_naive_network():
    """A byte and a unit at a time, window by window."""
    net = language.ByteGru(["a", "b", "c"], hidden=3)
    w, h = {k: v.astype(float) for k, v in net.weights.items()}, net.hidden
    texts = ["", "kurz", "é ü 東京 " * 30, "x" * (2 * language.WINDOW), None]
    found = language.pooled(net, pa.array(texts), block=4)
    for text, row in zip(texts, found, strict=True):
        raw, sums = (text or "").encode(), np.zeros(3)
        for at in range(0, len(raw), language.WINDOW):
            window = raw[at : at + language.WINDOW].ljust(language.WINDOW, b"\0")
            states = np.zeros((len(window), 2 * h))
            for way in range(2):
                s = np.zeros(h)
                for t in range(len(window)) if way == 0 else reversed(range(len(window))):
                    drive = w["embed"][way][window[t]]
                    gates = np.clip(0.25 * (s @ w["gates"][way] + drive[: 2 * h]) + 0.5, 0, 1)
                    fresh = np.tanh((gates[:h] * s) @ w["state"][way] + drive[2 * h :])
                    s = fresh + gates[h:] * (s - fresh)
                    states[t, way * h : (way + 1) * h] = s
            p = np.exp(states @ w["out"] + w["bias"])
            sums += (p / p.sum(1, keepdims=True))[: len(raw) - at].sum(0)
        assert np.abs(row - sums / max(len(raw), 1)).max() < 1e-4


def test_languages_are_held_out(spark, tmp_path):
    import zlib

    from tallystream.llm import queries

    rows = [(i, t, x, "s") for i, t, x in invented(2, 160)] + [(None, "the tion", "en", "s"), (900, "12 34", "fr", None), (901, None, "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op8_language(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, t, _, _ in rows:
        assert found[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert (found[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")) and found[i].lang_pred in {"und", "en", "de", "fr"}


def test_toxicity_sample_and_order(spark):
    """Repeated ids give one row each; later categories are fitted on probabilities of models that didn't see the row."""
    rows = [(k % 40, f"text {k % 40} " + ("vile awful" if k % 40 < 20 else "kind"), 1) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels, F.col("toxic") == 1, 100, 1000)) == 40
    r = np.random.default_rng(2)
    samples = [(f"{'vile ' * int(r.integers(0, 6)) if k % 2 else ''}{' '.join(r.choice(['aa', 'bb', 'cc', 'dd'], 9))}", bool(k % 2)) for k in range(200)]
    chain = toxicity.fit_chain(samples)
    x = chain.inputs([t for t, _ in samples])
    hits = np.array([t.split().count("vile") for t, _ in samples])
    assert chain.lexicon >= {"vile"} and np.allclose(np.expm1(x[:, -2] * 2), hits)
    y = toxicity.level_labels(np.array([c for _, c in samples], float), hits, np.array([len(t.split()) for t, _ in samples]), chain.levels)
    fold, own = np.arange(200) % 5, np.zeros(200)
    for f in range(5):
        w, b = toxicity.logistic(x[fold != f], y[fold != f, 0], 1e-4)
        own[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w + b)))
    w, b = toxicity.logistic(np.hstack((x, np.log(np.clip(own, 1e-3, 0.999) / (1 - np.clip(own, 1e-3, 0.999)))[:, None])), y[:, 1], 1e-4)
    assert np.allclose(chain.weights[1], w, atol=1e-6) and abs(chain.biases[1] - b) < 1e-6
    flags = chain.flags(chain.probabilities(x))
    assert not (flags[:, 1] & ~flags[:, 0]).any() and (flags[:, 1] != flags[:, 0]).any()
    assert np.mean(flags == (y > 0)) > 0.9


def test_toxicity(spark):
    r = random.Random(3)
    rows = [(i, t + (" you " + r.choice(["idiot", "scum", "moron trash"]) if i % 5 == 0 else ""), i % 5 == 0) for i, t, _ in invented(5, 300)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 3] + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, F.col("toxic") == 1)
    found = {x.doc_id: x for x in toxicity.score(docs, chain).collect()}
    assert np.mean([found[i].is_toxic == y for i, _, y in rows if i % 3 == 0]) >= 0.95
    assert chain.categories == ["toxic", "severe", "dense"] and len(chain.weights[2]) == len(chain.places) + 4
    assert {"moron", "trash"} <= chain.lexicon
    odd = toxicity.score(cases.frame(spark), chain).collect()
    assert len(odd) == len(cases.awkward()) and all(0 <= x.p_toxic <= 1 for x in odd)
    empty = toxicity.fit(docs, labels.limit(0), F.col("toxic") == 1)
    assert not any(x.is_toxic for x in toxicity.score(docs, empty).collect())


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_personal(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if pii.valid(k, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 2.@+-(_%0é9:", max_size=60))
def test_personal_base_spans(text):
    assert pii.base_spans(text) == brute_personal(text)


def test_personal_checks():
    assert pii.luhn("4405240589021364") and not pii.luhn("4405240589021365")
    assert pii.base_spans("1." * 3 + "9" * 5000) == [] and pii.base_spans("a" * 100_000 + "@") == []
    assert pii.redacted("a joe@x.org b", [(2, 0, 11)]) == "a [EMAIL] b"
    tags = pii.tags_of(9, [(1, 0, 4), (3, 2, 6), (6, 3, 8)])
    assert pii.spans_of(tags) == [(1, 0, 4), (6, 3, 8)]


def test_crf_gradients():
    net = pii.Tagger(hidden=3, size=4)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    r = np.random.default_rng(1)
    x, gold = r.integers(40, 60, (3, 7)).astype(np.uint8), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 7, 8, 8, 0]], np.int8)

    def loss():
        e, moves = net.emissions(x), net.moves()
        total = 0.0
        for b in range(3):
            a = e[0, :, b] + net.banned[0] * -1e4
            score = a[gold[b, 0]]
            for t in range(1, 7):
                a = e[t, :, b] + np.logaddexp.reduce(a[:, None] + moves, 0)
                score += e[t, gold[b, t], b] + moves[gold[b, t - 1], gold[b, t]]
            total += np.logaddexp.reduce(a) - score
        return total / 3

    grad = net.gradients(x, gold)
    for name, w in net.weights.items():
        flat = w.reshape(-1)
        for k in r.choice(np.flatnonzero(np.abs(grad[name].reshape(-1)) > 1e-4), 6):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[k]) < 1e-4


def slow_path(net, window):
    """The best tags of one window, a character and a unit at a time, and a table of all paths' bests."""
    w, h, k = net.weights, net.hidden, net.TAGS
    states = np.zeros((len(window), 2 * h))
    for way in range(2):
        s, c = np.zeros(h), np.zeros(h)
        for t in range(len(window)) if way == 0 else reversed(range(len(window))):
            x = w["gates"][way] @ np.concatenate((w["embed"][window[t]], s, [1.0]))
            i, f, o = (np.clip(x[j * h : (j + 1) * h], 0, 1) for j in range(3))
            c = f * c + i * np.tanh(x[3 * h :])
            s = o * np.tanh(c)
            states[t, way * h : (way + 1) * h] = s
    e, moves = states @ w["out"][:, :-1].T + w["out"][:, -1], net.moves()
    best = {y: (e[0, y] + (-1e4 if net.banned[0, y] else 0), [y]) for y in range(k)}
    for t in range(1, len(window)):
        best = {y: max(((best[z][0] + moves[z, y] + e[t, y], [*best[z][1], y]) for z in range(k)), key=lambda p: p[0]) for y in range(k)}
    return max(best.values(), key=lambda p: p[0])[1]


def test_tagger_is_its_slow_form():
    r = np.random.default_rng(4)
    for bias in (0.0, 8.0):  # without and with windows that need no path
        net = pii.Tagger(hidden=4, size=3)
        net.weights = {k: v.astype(float) for k, v in net.weights.items()}
        net.weights["out"][0, -1] += bias
        x = r.integers(32, 131, (20, 12)).astype(np.uint8)
        assert net.decode(x).tolist() == [slow_path(net, row) for row in x]
    net = pii.Tagger(hidden=4)
    text = "".join(r.choice(list("ab 01@.é"), 1000))
    whole, codes, edge = pii.tagged(net, ["", text, "x"])[1], pii.encode(text), (pii.WINDOW - pii.STRIDE) // 2
    for start in range(0, len(text), pii.STRIDE):
        window = np.full((1, pii.WINDOW), net.PAD, np.uint8)
        part = codes[start : start + pii.WINDOW]
        window[0, : len(part)] = part
        path, last = net.decode(window)[0], start + pii.WINDOW >= len(text)
        a, b = edge if start else 0, len(part) if last else pii.WINDOW - edge
        assert whole[start + a : start + b].tolist() == path[a:b].tolist()
        if last:
            break


def carriers(seed, n):
    """Texts with base items in some, and the words " at " and "dot" and plain numbers in others."""
    r = random.Random(seed)
    number = lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    odd = lambda: r.choice([number(), "meet at noon", f"{''.join(r.choices('abcdef', k=5))}@mail.example.com", f"{r.randrange(10**15, 10**16)}", f"10.0.{r.randrange(300)}.7", "the dot at 12", "on 2024-03-05 at 10:30", ""])
    return [f"{t[:80]} {odd()} {t[80:200]} {odd()} {t[200:]}" for _, t, _ in invented(seed, n)]


def test_personal_network_adds_what_patterns_miss(spark):
    net = pii.train(carriers(6, 400), windows=4000)
    rng, r = np.random.default_rng(77), random.Random(5)
    names = ["smith", "kovacs", "umbra", "lindt", "okafor", "bright"]  # none of the training's syllables
    found = planted = added = 0
    texts, gold = [], []
    for text in carriers(9, 240):
        kind, words = int(rng.integers(4)), text.split(" ")
        item = pii.planted(rng, kind)
        if kind == 0:
            dot = r.choice([" dot ", "[dot]", " (dot) "])
            item = r.choice(names) + "." + r.choice(names) + r.choice([" at ", "[at]", " (at) "]) + r.choice(names) + dot + r.choice(["com", "org"])
        k = r.randrange(len(words))
        head = " ".join(words[:k]) + " " if k else ""
        texts.append(head + item + " " + " ".join(words[k:]))
        gold.append((len(head), kind, len(head) + len(item)))
    for (base, spans), want in zip(pii.find(net, texts), gold, strict=True):
        assert set(base) <= set(spans)
        new = set(spans) - set(base)
        found, planted, added = found + (want in new), planted + 1, added + len(new)
    assert found >= 0.8 * planted and found >= 0.9 * added, (found, planted, added)
    clean = carriers(12, 300)
    assert sum(len(a) - len(b) for b, a in pii.find(net, clean)) <= 3
    rows = pii.scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), net).collect()
    assert sum(x.n_added for x in rows) == added
    assert pii.find(net, ["x" * 150_000 + " 4405 2405 8902 1364 " + "y " * 30_000])[0][1] == [(150_001, 2, 150_020)]


def test_personal_spans_lie_on_borders():
    assert pii.snapped("call (201) 555-0123.", 6, 19) == (5, 19) and pii.snapped("abc def", 1, 2) == (0, 3)
    assert pii.snapped("x" * 200, 90, 100) is None and pii.snapped(" .. ", 1, 3) is None
    assert pii._continues("12-4405", 3, 7) and not pii._continues("12 4405", 3, 7)
    assert pii.plain(0, "a.b [at] c (dot) de") == "a.b@c.de" and pii.plain(1, "1[.]2 dot 3(.)4") == "1.2.3.4"
    rng = np.random.default_rng(0)
    for k in range(400):
        item = pii.planted(rng, k % 4)
        assert pii._plausible(k % 4, item), item
        assert pii.base_spans(item) == [] or k % 4, item


def test_personal_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}", 1) for k in range(200)], "doc_id long, text string, id int")
    seen = []
    pii_train, pii.train = pii.train, lambda texts: seen.append(texts)
    try:
        pii.fit(docs, rows=4)
    finally:
        pii.train = pii_train
    assert len(seen[0]) == 4


def test_personal_network(spark):
    net = pii.train(carriers(3, 50), windows=300, passes=1)
    rows = pii.scan(cases.frame(spark), net, keep=("doc_id", "text")).collect()
    assert len(rows) == len(cases.awkward())
    for x in rows:
        base = brute_personal(x.text or "")
        assert x.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, pii.joined(base).split(","))) <= set(x.spans.split(","))
    clean = pii.redact(cases.frame(spark), net).collect()
    assert {x.text for x in clean if x.doc_id == 11} == {"mail [EMAIL], ip [IP] or 300.1.1.1, card [CARD], phone [PHONE]."}
    assert pii.fit(cases.frame(spark, [])) and pii.scan(cases.frame(spark, []), net).collect() == []


SECRETS = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def test_secrets(spark):
    r = random.Random(11)
    bits = ["password", "Token", "secret", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abc", "AKIA", "ABCDEFGH12", "0123456789abcdef", "é", "x", "\n", "token=secret", "-", "ffffffff", "Zk93jf0aKd03mfkQpw03KdmsQz"]
    texts = ["".join(r.choices(bits, k=r.randrange(25))) for _ in range(400)]
    rows = [(i, t, f"s{i % 3}", f"r{i % 7}", 1) for i, t in enumerate(texts)] + [(1000 + i, t, None, None, 1) for i, (_, t, *_) in enumerate(cases.awkward())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string, value int").repartition(3)
    found = {x.doc_id: x for x in secrets.scan(docs, owner=F.col("source"), repo=F.col("repo")).collect()}
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= n)
        listed = ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in spans)
        x = found[doc_id]
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))
        assert x.n_live + x.n_copied == len(list(filter(None, x.spans.split(","))))
        assert len(x.held.split(",")) == len(x.spans.split(",")) and x.held.count("copied") == x.n_copied
    holders = collections.defaultdict(set)
    for doc_id, text, owner, repo, _ in rows:
        for k, (_, p, g, n) in enumerate(SECRETS):
            for m in p.finditer(text or ""):
                if len(m[g]) >= n:
                    holders[m[g]].add((owner, repo))
    for doc_id, text, *_ in rows:
        told = dict(zip(found[doc_id].spans.split(","), found[doc_id].held.split(","), strict=True))
        for k, (name, p, g, n) in enumerate(SECRETS):
            for m in p.finditer(text or ""):
                if len(m[g]) >= n:  # other kinds may hold the same value too
                    label, owners, repos = told[f"{name}:{m.start()}:{m.end()}"].split(":")
                    assert int(owners) >= len({o for o, _ in holders[m[g]]}) and int(repos) >= len(holders[m[g]])
                    assert (label == "copied") == (int(owners) >= secrets.COPIED_OWNERS or int(repos) >= secrets.COPIED_REPOS)
    assert secrets.scan(docs.limit(0)).collect() == []


def test_ownership(spark, monkeypatch):
    monkeypatch.setattr(_filter, "HEAVY", 3)
    key = "Zk93jf0aKd03mfkQpw03KdmsQz"
    rows = [(1, f"a {key} b", "s1"), (2, f"AKIA{'A' * 16}", "s1"), (3, f"AKIA{'A' * 16}", "s2"), (4, f"x {key[::-1]}", "s1"), (5, f"x {key[::-1]}", "s2")]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[1].spans == "generic:2:28" and (found[1].n_live, found[1].n_copied) == (1, 0)
    assert found[2].spans == "access:0:20" and (found[2].n_live, found[2].n_copied) == (0, 1)
    assert found[4].spans == "" == found[5].spans
    assert [found[k].held for k in (1, 2, 3, 4)] == ["live:1:1", "copied:2:2", "copied:2:2", ""]
    assert json.dumps([r.n_copied for r in found.values()])
