"""Near-duplicates and decontamination against brute force."""

import hashlib
import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest

from tallystream.llm import _filter, decontaminate, neardup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None] if sets[i] else [doc_id]
        least = min((x for x in ids if x is not None), default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least if least is not None and doc_id is not None else least is None))
    return sorted(out, key=repr)


def near(spark, rows, k):
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, uid int, n int"), k=k).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_of_awkward_rows(spark, k):
    rows = [(r[0], r[1], 1, 2) for r in cases.awkward()]
    assert near(spark, rows, k) == brute_components([r[:2] for r in rows], k)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(80)] = f"x{i}.{r.randrange(1000)}"
        rows.append((i, " ".join(w), 0, 0))
    rows += [(100, "", 0, 0), (101, "single", 0, 0), (102, "SINGLE", 0, 0)]
    r.shuffle(rows)
    assert near(spark, rows, 2) == brute_components([x[:2] for x in rows], 2)


def changed(r, words, share, mark):
    """The words with about that share of them replaced by others."""
    return [w if r.random() > share else f"{mark}.{r.randrange(10**6)}" for w in words]


def test_near_duplicates_of_unlike_pages_of_a_template(spark, monkeypatch):
    """Pages that share much, but not enough, and chains and pairs among them; large buckets everywhere."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4000)
    r = random.Random(11)
    template = [f"t{k}" for k in range(120)]
    rows = [(i, " ".join([*template, *(f"p{i}.{k}" for k in range(40))]), 0, 0) for i in range(40)]
    chain = [*template, *(f"q{k}" for k in range(40))]
    for i in range(25):  # each is near the one before, and soon not near the first
        chain = [*chain[:120], *changed(r, chain[120:], 0.2, f"c{i}")]
        rows.append((100 + i, " ".join(chain), 0, 0))
    rows += [(200 + i, " ".join(changed(r, template, 0.12, f"v{i}")), 0, 0) for i in range(20)]
    r.shuffle(rows)
    assert near(spark, rows, 2) == brute_components([x[:2] for x in rows], 2)


def test_near_duplicates_without_ids_and_beyond_the_broadcast(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(None if i % 3 else i, " ".join(changed(r, base, 0.08, f"x{i}")), 0, 0) for i in range(60)]
    rows += [(None, f"other text {i} of its own", 0, 0) for i in range(40)] + rows[:9]
    wanted = brute_components([x[:2] for x in rows], 2)
    assert near(spark, rows, 2) == wanted
    monkeypatch.setattr(neardup, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(neardup, "SMALL", 4)
    assert near(spark, rows, 2) == wanted


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    rounds = []
    written = neardup.staged
    monkeypatch.setattr(neardup, "staged", lambda df, name: (rounds.append(name), written(df, name))[1])
    path = spark.range(499).selectExpr("id AS a", "id + 1 AS b")
    star = spark.range(200).selectExpr("1000L AS a", "id + 1001 AS b")
    found = {r.node: r.label for r in neardup.components(path.union(star).union(spark.createDataFrame([(5, 5), (7000, 7001)], "a long, b long"))).collect()}
    assert rounds.count("first") <= 16
    assert len({found[k] for k in range(500)}) == 1 and len({found[k] for k in range(1000, 1201)}) == 1
    assert len(found) == 500 + 201 + 2 and len(set(found.values())) == 3
    assert neardup.components(path.limit(0)).collect() == []


def test_bitmaps_and_heavy_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k if k % 50 else None, f"t{k}") for k in range(2000)], "k long, t string")
    gone = spark.createDataFrame([(k,) for k in range(0, 2000, 7)] + [(None,)], "gone long")
    wanted = {f"t{k}" for k in range(2000) if k % 7 or k % 50 == 0}
    for small in (0, 10**6):
        assert {r.t for r in _filter.without(rows, "k", gone, small).collect()} == wanted
        assert {r.t for r in _filter.within(rows, "k", gone, "gone", small).collect()} == {f"t{k}" for k in range(0, 2000, 7) if k % 50}
    plan = _filter.without(rows, "k", gone, 0)._jdf.queryExecution().toString()
    assert "__maybe" in plan or "__bits" in plan
    keys = spark.createDataFrame([(k % 3 if k < 900 else k if k < 990 else None, k) for k in range(1000)], "k long, v long")
    side = keys.filter("k IS NOT NULL").groupBy("k").count().selectExpr("k AS of", "count AS n", "k * 2 AS w")
    monkeypatch.setattr(_filter, "HEAVY", 10)
    found = _filter.by_weight(keys, "k", side.filter("of <> 950"), "of", "n", 1000).collect()
    assert {(r.v, r.w) for r in found} == {(r.v, None if r.k is None or r.k == 950 else 2 * r.k) for r in keys.collect()} and len(found) == 1000


def test_near_duplicates_of_nothing(spark):
    assert near(spark, [], 2) == []
    assert near(spark, [(1, None, 0, 0), (None, "", 0, 0)], 2) == [(1, 0, 1, True), (None, 0, None, True)]


def test_shingle_sets_match_words():
    r = random.Random(2)
    texts = [None, "", " ", "a", "A b", "\n\ta  b\x0bc ", *("".join(r.choice("ab C\n é") for _ in range(r.randrange(30))) for _ in range(500))]
    for k in (1, 2, 3, 5):
        seen = {}
        for text, hashes in zip(texts, neardup.shingle_sets(pa.array(texts), k), strict=True):
            words = shingles(text, k)
            assert len(hashes) == len(words)
            assert seen.setdefault(frozenset(words), hashes.tobytes()) == hashes.tobytes()
        assert len(set(seen.values())) == len(seen)


def test_bounds_follow_the_posterior():
    for n, least in neardup.bayes_bounds(0.8):
        p = 0.8 + 0.2 / 256
        grid = (np.arange(200_000) + 0.5) / 200_000
        for m, dropped in ((least - 1, True), (least, False)):
            if m < 0:
                continue
            density = grid**m * (1 - grid) ** (n - m)
            assert (density[grid >= p].sum() / density.sum() < neardup.MISS) == dropped


def brute_hits(docs, items, window=10):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    parsed = [(i, find(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        w, hit, found = find(text), set(), set()
        for item, v in parsed:
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if v else []:
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit.update(range(at, at + n))
                        if item is not None:
                            found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def decontaminated(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, hash int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in decontaminate.decontaminate(d, b).collect()), key=repr)


@pytest.mark.parametrize("bound", [10**6, 1, 0])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", bound)
    monkeypatch.setattr(_filter, "HEAVY", 1_000 if bound > 1 else 20)
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("the of A b é x9".split()) for _ in range(n))
    items = [(1, text(12), 0), (2, text(30), 0), (2, text(11), 0), (3, "one two", 0), (4, "Solo", 0), (5, "", 0), (6, None, 0), (None, "no id here but five", 0), (7, "the the the", 0)]
    docs = [(r[0], r[1], "x", 1) for r in cases.awkward()]
    docs += [(50, f"{text(5)} {items[0][1]} {text(5)}", "x", 1), (51, items[1][1].upper(), "x", 1), (52, "solo! ONE-two", "x", 1), (53, f"{items[1][1]} {items[1][1]}", "x", 1), (54, "no id here but five", "x", 1), (55, "the the the the the", "x", 1), (55, "the the the the the", "x", 1)]
    assert decontaminated(spark, docs, items) == brute_hits([d[:2] for d in docs], [i[:2] for i in items])


def test_decontamination_of_nothing(spark):
    assert decontaminated(spark, [], [(1, "a b", 0)]) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert decontaminated(spark, [(1, "a b", "x", 1)], []) == [(1, 2, 0, 0, empty, False)]
