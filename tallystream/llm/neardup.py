"""Near-duplicate detection by MinHash with sequential Bayesian verification.

Documents with equal shingle sets are one class.  Classes that share a band of
their MinHash signature are candidates.  A candidate pair's signatures are
compared batch by batch: with a uniform prior, the pair is dropped as soon as
the posterior probability that it reaches the threshold falls below a chosen
miss probability.  What survives is verified on the full sets.

Pairs within a bucket of equal bands are never listed.  Every member is first
compared with one pivot of its bucket; verified links are contracted to
components; then only members of different components are compared, in small
buckets as pairs.  Members of large ones are first bucketed anew by their
rarest shingles, of which similar sets share one (so nothing is lost, and pages
that only share a template part); where such a bucket is large too, its sets are
compared in blocks of bounded bytes, of which a spanning forest of links leaves
the worker.  So no link between candidates is lost, and the work beyond the
pivots follows the members that are still apart.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm._arrow import arrow_map, map_texts, utf8
from tallystream.llm._filter import by_weight, within
from tallystream.llm._scratch import staged

#: Bands of a signature and hashes of a band; a pair at 0.8 shares no band with probability 5e-6.
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Hashes compared before each posterior bound, and the probability at which a pair is dropped.
BATCH, MISS = 24, 1e-7
#: Members up to which a bucket's remaining pairs are listed, and members and bytes of a block beyond.
SMALL, BLOCK, BLOCK_BYTES = 32, 256, 1 << 21
#: Places of the table of counts by which shingles are ordered; it is 1 MB.
COUNTERS = 1 << 18
#: Classes, of under 100 bytes each, up to which those whose texts are wanted are broadcast.
BROADCAST_CLASSES = 100_000

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 19)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's ``k``-word shingles.

    A-Z are lower-cased and words are runs without ASCII white space.  A text of
    fewer words has one shingle, all of them; one without words has none.
    """
    offsets, raw = utf8(texts)
    n = len(raw)
    space = np.ones(n + 2, bool)  # as if white space stood around the whole
    space[1:-1] = _SPACE[raw]
    begins = ~space[1:-1] & space[:-2]
    ends = ~space[1:-1] & space[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begins[cuts] = ~space[1:-1][cuts]
    ends[cuts - 1] = ~space[1:-1][cuts - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[raw] * power[:n], out=total[1:])
    word = _mix((total[end + 1] - total[begin]) * inverse[begin] + (end - begin + 1).astype(np.uint64) * _ODD[63])
    first = np.searchsorted(begin, offsets)
    out = []
    m = len(word) - k + 1
    if m > 0:
        rolled = word[:m] * _ODD[0]
        for j in range(1, k):
            rolled += word[j : j + m] * _ODD[j]
        rolled = _mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(_mix(np.array([(word[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512, None] * _A + _B).min(0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, distinct between bands."""
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return _mix((parts * _ODD[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[60])


def digest(shingles: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache
def bayes_bounds(threshold: float, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(hashes compared, least matches) after each batch.

    The low byte of each hash is compared, so unequal ones match once in 256.
    With m of n matches the posterior of the match probability is
    Beta(m + 1, n - m + 1); its upper tail is a binomial lower tail.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Indexes of the rows of ``a`` and ``b`` (n, HASHES) that no bound drops."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in bayes_bounds(threshold, miss):
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        at = n
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``100 * |a & b| >= percent * |a | b|``."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _place(doc_id: str, text: str):
    """A hash by which a document is found again; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text).cast("string"))


def fingerprints(docs: DataFrame, doc_id: str, text: str, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Staged, one row a document row: ``uid``, ``place``, ``doc_id``, ``n``, ``digest``, ``sig`` (low bytes) and ``bands``; null without shingles."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), _place(doc_id, text).alias("place"), F.col(doc_id).alias("doc_id"), *extra, F.col(text).alias("text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def compute(texts):
        sets = shingle_sets(texts, k)
        sigs = [signature(s) if len(s) else None for s in sets]
        return [
            [len(s) for s in sets], [digest(s) if len(s) else None for s in sets],
            [None if x is None else x.astype(np.uint8).tobytes() for x in sigs], [None if x is None else band_keys(x).view(np.int64).tolist() for x in sigs],
        ]

    return staged(map_texts(rows, "text", ["uid", "place", "doc_id", *extra], fields, lambda: compute, 1 << 18), "fingerprints")


def classes_of(prints: DataFrame) -> DataFrame:
    """Staged, one row a distinct set: ``node`` (the least uid) and its ``place``, ``id`` (the least doc_id), ``count``, ``digest``, ``n``, ``sig``, ``bands``."""
    groups = prints.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("id"), F.count("*").alias("count"))
    rows = prints.select(F.col("uid").alias("node"), "place", "n", "sig", "bands")
    return staged(groups.join(rows, "node"), "classes")


def bucket_members(classes: DataFrame) -> DataFrame:
    """Staged: ``key``, ``node``, ``pivot`` and ``size`` of every bucket of several classes.

    The pivot is the class with the most copies, then the least node: copies
    gather around what they were copied from.
    """
    rows = classes.select("node", "count", F.explode("bands").alias("key"))
    rank = F.struct((-F.col("count")).alias("copies"), F.col("node").alias("node"))
    buckets = rows.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("size"), F.min(rank).alias("first")).filter("size > 1")
    joined = rows.join(buckets, F.col("key") == F.col("bucket"))
    return staged(joined.select("key", "node", F.col("first.node").alias("pivot"), "size"), "members")


def _bayes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sizes can reach the threshold and whose signatures no bound drops."""
    side = classes.select("node", "n", "sig")
    left = side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in (2, 3))
            keep = pa.array(surviving(x, y, percent / 100))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return arrow_map(both, run, "a long, b long")


def _texts(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, nodes: DataFrame, k: int, sets: bool = False) -> DataFrame:
    """Staged: ``node`` and ``text`` of one document of each wanted class, or its sorted shingle hashes as ``set``.

    Documents are found by a hash of id and text, and kept if their set has the
    class's digest.
    """
    wanted = staged(classes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", F.col("place").alias("at"), "digest"), "wanted")
    rows = docs.select(_place(doc_id, text).alias("place"), F.col(text).cast("string").alias("text"))
    rows = within(rows, "place", wanted, "at", BROADCAST_CLASSES).select("node", "digest", "text")
    out = "set" if sets else "text"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = shingle_sets(part.column(2), k)
                same = [digest(s) == d for s, d in zip(found, part.column(1).to_pylist(), strict=True)]
                wide = pa.array([s.tobytes() for s in found], pa.binary()) if sets else part.column(2)
                yield pa.RecordBatch.from_arrays([part.column(0), wide], ["node", out]).filter(pa.array(same, pa.bool_()))

    return staged(arrow_map(rows, run, f"node long, {out} {'binary' if sets else 'string'}").dropDuplicates(["node"]), out)


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Staged: the pairs ``a``, ``b`` of classes that reach the threshold on their full sets."""
    alive = staged(_bayes(pairs, classes, percent), "alive")
    nodes = alive.select(F.col("a").alias("node")).unionByName(alive.select(F.col("b").alias("node")))
    texts = _texts(docs, doc_id, text, classes, nodes, k)
    both = alive.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                left, right = shingle_sets(part.column(2), k), shingle_sets(part.column(3), k)
                keep = pa.array([linked(x, y, percent) for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return staged(arrow_map(both, run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """Staged: ``node`` and ``label`` (equal within a component) of every node of the links ``a``, ``b``.

    In each round every node takes its first neighbour by a hash, or stays if it
    comes before all, and the graph is contracted until no link is left.  On a
    path half of the nodes or more go in a round, whatever their numbers are,
    and a star goes in two, so rounds follow the logarithm of the length.
    The rounds' tables shrink alike and are put together from the last one back.
    """
    edges = staged(links.filter("a <> b").select("a", "b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c)).alias("rank"), F.col(c).alias("node"))
        both = edges.select(F.col("a").alias("u"), ranked("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), ranked("a").alias("v")))
        first = staged(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least(ranked("u"), "v")["node"].alias("low")), "first")
        rounds.append(first)
        a = first.select(F.col("u").alias("a"), F.col("low").alias("low_a"))
        b = first.select(F.col("u").alias("b"), F.col("low").alias("low_b"))
        contracted = edges.join(a, "a").join(b, "b").filter("low_a <> low_b")
        edges = staged(contracted.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1].select(F.col("u").alias("node"), F.col("low").alias("label"))
    for first in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("of"), F.col("label").alias("later"))
        labels = first.join(later, F.col("low") == F.col("of"), "left").select(F.col("u").alias("node"), F.coalesce("later", "low").alias("label"))
    return staged(labels, "labels")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged: members, with ``label``, of the buckets that hold several components, and whether each is of the largest one there."""
    known = members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    per_label = known.groupBy("key", "label").agg(F.count("*").alias("m"))
    per_key = per_label.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("top")).filter("labels > 1")
    joined = known.join(per_key, F.col("key") == F.col("bucket"))
    return staged(joined.select("key", "node", "size", "label", (F.col("label") == F.col("top.label")).alias("top")), "apart")


def _prefix_members(sets: DataFrame, percent: int) -> DataFrame:
    """Staged ``key``, ``node`` and ``size``: the buckets of several classes whose sets share one of their rarest shingles.

    Two sets that reach the threshold share one of the first
    ``n - ceil(percent * n / 100) + 1`` shingles of either in any common order.
    Here it is by a hashed count over all the sets, then by hash.
    """

    def tokens(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                place, n = np.unique(np.frombuffer(body, np.uint64) % np.uint64(COUNTERS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(n)], ["place", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for r in arrow_map(sets.select("set"), tokens, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["place"]] = r["n"]

    def prefixes(batches):
        for batch in batches:
            for node, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(body, np.uint64)
                first = np.lexsort((x, counts[(x % np.uint64(COUNTERS)).astype(np.int64)]))[: len(x) - -(-percent * len(x) // 100) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(np.full(len(first), node))], ["key", "node"])

    rows = staged(arrow_map(sets.select("node", "set"), prefixes, "key long, node long"), "prefixes")
    sizes = rows.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("size")).filter("size > 1")
    return staged(rows.join(sizes, F.col("key") == F.col("bucket")).select("key", "node", "size"), "prefix-members")


def _block_links(apart: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components of large buckets, found block by block.

    A block holds about ``BLOCK`` members of a bucket, or ``BLOCK_BYTES`` of
    their sets if that are fewer, and as many outside its largest component.  Of
    its links those are kept that join what isn't joined yet.
    """
    large = apart.join(classes.select("node", "sig", F.col("n").alias("bytes")), "node").withColumn("bytes", 8 * F.col("bytes") + HASHES)
    parts = lambda members, size: F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    per_key = large.groupBy(F.col("key").alias("bucket")).agg(parts(F.count("*"), F.sum("bytes")).alias("members"), parts(F.count_if(~F.col("top")), F.sum(F.when(~F.col("top"), F.col("bytes")))).alias("others"))
    large = large.join(per_key, F.col("key") == F.col("bucket"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = large.select("key", "node", "label", "sig", own("members").alias("i"), all_of("others").alias("j"), F.lit(False).alias("probe")).unionByName(
        large.filter(~F.col("top")).select("key", "node", "label", "sig", all_of("members").alias("i"), own("others").alias("j"), F.lit(True).alias("probe"))
    )
    rows = rows.join(sets, "node").select("key", "i", "j", "probe", "node", "label", "sig", "set")

    def run(table: pa.Table) -> pa.Table:
        probe, node, label = (np.array(table.column(c).to_pylist()) for c in ("probe", "node", "label"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        group = np.unique(label, return_inverse=True)[1]
        found, rest = [], np.flatnonzero(~probe)
        for p in np.flatnonzero(probe).tolist():
            near = rest[(group[rest] != group[p]) & (100 * np.minimum(size[rest], size[p]) >= percent * np.maximum(size[rest], size[p]))]
            for q in near[surviving(sig[near], np.broadcast_to(sig[p], (len(near), HASHES)), percent / 100)].tolist():
                if group[q] != group[p] and linked(sets[p], sets[q], percent):
                    found.append((min(node[p], node[q]), max(node[p], node[q])))
                    group[group == group[q]] = group[p]
        return pa.table({"a": pa.array([int(x) for x, _ in found], pa.int64()), "b": pa.array([int(y) for _, y in found], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _cross(apart: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of members of different components of small buckets."""
    one, two = (apart.select("key", F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    return one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))).select("a", "b").distinct()


def all_links(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links ``a``, ``b`` that join every component of the candidate graph."""
    members = bucket_members(classes)
    star = members.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = verified(star, docs, doc_id, text, classes, k, percent)
    labels = components(links)
    apart = _apart(members, labels)
    cross = _cross(apart.filter(F.col("size") <= SMALL))
    large = staged(apart.filter(F.col("size") > SMALL).select("node").distinct(), "large")
    if not large.isEmpty():
        sets = _texts(docs, doc_id, text, classes, large, k, sets=True)
        again = _apart(_prefix_members(sets, percent), labels)
        cross = cross.unionByName(_cross(again.filter(F.col("size") <= SMALL))).distinct()
        links = links.unionByName(staged(_block_links(again.filter(F.col("size") > SMALL), sets, classes, percent), "block-links"))
    return links.unionByName(verified(cross.join(star, ["a", "b"], "left_anti"), docs, doc_id, text, classes, k, percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, extra: tuple[str, ...] = ()) -> DataFrame:
    """Components of documents whose ``k``-word shingle sets are similar; one row a document row.

    Columns ``doc_id``, ``n_shingles``, ``component_id`` (the least id that can
    be reached over links with ``100 * |a & b| >= percent * |a | b|``, its own
    included), ``kept`` (whether that is its own), ``group`` (a number of the
    component, null without shingles) and the columns ``extra``.  A null text, or one
    without words, has no shingles and no links.  Repeated rows have equal sets
    and are both kept if their id is the component's.  A null id is larger than
    any other; a component without ids has a null ``component_id`` and is kept.
    """
    prints = fingerprints(docs, doc_id, text, k, extra)
    classes = classes_of(prints)
    labels = components(all_links(docs, doc_id, text, classes, k, percent))
    named = classes.select("digest", "node", "id", "count").join(labels, "node", "left").select("digest", "id", "count", F.coalesce("label", "node").alias("label"))
    # A table of its own: joined with what it was counted from, a large component would be one task's.
    least = staged(named.groupBy(F.col("label").alias("of")).agg(F.min("id").alias("component")), "least-ids")
    by_digest = staged(named.join(least, F.col("label") == F.col("of")).select(F.col("digest").alias("set"), "component", F.col("label").alias("group"), "count"), "components")
    total = by_digest.agg(F.sum("count")).collect()[0][0] or 0
    rows = by_weight(prints.select("doc_id", "n", "digest", *extra), "digest", by_digest, "set", "count", total)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "group", *extra)


#: DuckDB SQL with the rows of ``near_duplicates(k=2)``, by comparing all documents that share a shingle, for distinct ids.
SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN list_transform(range(1, len(w) + 1), lambda i: w[i]) ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM low),
texts AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM shingles WHERE len(s) > 0 GROUP BY 1),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM texts),
pairs AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM tokens a JOIN tokens b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * i >= 80 * (n + m - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT rep, rep FROM texts),
reach AS (SELECT x AS node, y AS low FROM edges UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.low = e.x),
least_id AS (SELECT node, min(low) AS component FROM reach GROUP BY 1)
SELECT doc_id, len(shingles.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM shingles LEFT JOIN texts ON list_sort(shingles.s) = texts.s LEFT JOIN least_id ON rep = node
"""
