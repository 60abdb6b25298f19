"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item is a set of windows, each a set of positioned shingles (short word
runs).  Containment of a whole window needs all of its shingles, so one of
them, the rarest in the documents, is the necessary prefix: a window is only
sought where that shingle stands.  Bounds on position and length drop starts
that would leave the text, and the words around the place settle containment.

Documents are scanned once: the places of any benchmark shingle are staged
with the words around them, then counted to order the shingles by rarity, and
joined with the prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm._filter import marked, salted
from tallystream.llm._native import ascii_lower
from tallystream.llm._scratch import staged

#: Runs of digits, lower-case letters and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Distinct benchmark shingles, of 8 bytes each, up to which they are broadcast.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_hashes(w: Column, size: int) -> Column:
    """A hash of the ``size`` words from each word on; those that run over the end are hashes of fewer."""
    return F.transform(w, lambda x, i: F.xxhash64(F.lit(size), x, *[F.get(w, i + k) for k in range(1, size)]))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows of the items: ``item``, ``win`` (its words), ``len`` and ``size`` of its shingles."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    out = w.select("item", "w", F.explode(starts).alias("start")).select("item", F.slice("w", F.col("start"), F.lit(window)).alias("win"))
    return out.distinct().withColumn("len", F.size("win")).withColumn("size", F.least(F.col("len"), F.lit(shingle)))


def window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row a shingle of each window: its columns, ``off`` (place in the window) and ``hash``."""
    hashes = F.coalesce(*[F.when(F.col("size") == s, shingle_hashes(F.col("win"), s)) for s in sizes])
    return windows.select("*", F.posexplode(hashes).alias("off", "hash")).filter(F.col("off") <= F.col("len") - F.col("size"))


def shingle_places(docs: DataFrame, doc_id: str, text: str, grams: DataFrame, sizes: list[int], window: int = WINDOW, small: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """The places of benchmark shingles in the documents, and a row with null ``hash`` for each document.

    Columns ``uid`` (of the row), ``doc_id``, ``n_words``, ``at`` (the place),
    ``hash``, ``around`` (the words that any window over the place can hold) and
    ``first`` (the place of the first of them); the columns ``extra`` stand in
    the rows of documents.
    """
    w = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), *extra, words(F.col(text)).alias("w"))
    hashes = F.concat(F.array(F.lit(None).cast("long")), *[shingle_hashes(F.col("w"), s) for s in sizes])
    rows = w.select("uid", "doc_id", *extra, F.size("w").alias("n_words"), "w", hashes.alias("hashes")).select("uid", "doc_id", *extra, "n_words", "w", F.posexplode("hashes").alias("p", "hash"))
    known = grams.select(F.col("hash").alias("known"))
    if small:
        rows = rows.join(F.broadcast(known), F.col("hash") == F.col("known"), "left").filter((F.col("p") == 0) | F.col("known").isNotNull())
    else:  # only places that the bitmap marks, few beyond the benchmark's, get their words around and are shuffled
        rows = marked(rows, F.col("hash"), known, "maybe").filter((F.col("p") == 0) | F.col("maybe"))
    at = F.when(F.col("p") > 0, F.pmod(F.col("p") - 1, F.col("n_words")))
    rows = rows.withColumn("at", at).withColumn("first", F.greatest(F.col("at") - window + 1, F.lit(0)))
    around = F.when(F.col("p") > 0, F.slice("w", F.col("first") + 1, F.col("at") - F.col("first") + window))
    carried = [F.when(F.col("p") == 0, F.col(c)).alias(c) for c in extra]
    rows = rows.select("uid", "doc_id", *carried, "n_words", "at", "hash", around.alias("around"), "first")
    if not small:  # rows of documents, which have no hash, stay out of the shuffle
        found = rows.filter(F.col("hash").isNotNull()).join(known.hint("merge"), F.col("hash") == F.col("known"), "left_semi")
        rows = rows.filter(F.col("hash").isNull()).unionByName(found)
    return rows


def prefixes(windows: DataFrame, places: DataFrame, sizes: list[int]) -> DataFrame:
    """The rarest shingle of each window: its columns, ``off``, ``prefix`` (its hash) and ``places``.

    Rarity is the number of places in all documents; a window with a shingle
    that stands nowhere can't occur and is dropped.
    """
    counts = places.filter(F.col("hash").isNotNull()).groupBy(F.col("hash").alias("counted")).agg(F.count("*").alias("places"))
    shingles = window_shingles(windows, sizes)
    ranked = shingles.join(counts, F.col("hash") == F.col("counted"), "left").withColumn("places", F.coalesce("places", F.lit(0)))
    least = ranked.groupBy("item", "win", "len").agg(F.min(F.struct("places", "off", "hash")).alias("rarest"))
    return least.filter(F.col("rarest.places") > 0).select("item", "win", "len", F.col("rarest.off").alias("off"), F.col("rarest.hash").alias("prefix"), "rarest.places")


def occurrences(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """Verified occurrences: ``uid``, ``start``, ``end`` (exclusive) and ``item``."""
    start = F.col("at") - F.col("off")
    found = places.filter(F.col("hash").isNotNull())
    joined = salted(found, "hash", prefix, "prefix", "places", found.count(), F.xxhash64("uid", "at"))
    bounded = joined.filter((start >= 0) & (start + F.col("len") <= F.col("n_words")) & (start >= F.col("first")))
    exact = bounded.filter(F.slice("around", start - F.col("first") + 1, F.col("len")) == F.col("win"))
    return exact.select("uid", start.alias("start"), (start + F.col("len")).alias("end"), "item")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("done"))

    def step(acc, x):
        done = F.greatest(acc["done"], x["end"])
        return F.struct((acc["n"] + done - F.greatest(acc["done"], x["start"])).alias("n"), done.alias("done"))

    # A span that ends within what is done adds nothing: then done minus the greater start is at most 0.
    def guarded(acc, x):
        return F.when(x["end"] > acc["done"], step(acc, x)).otherwise(acc)

    return F.aggregate(spans, zero, guarded)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, extra: tuple[str, ...] = ()) -> DataFrame:
    """Windows of benchmark items in documents; one row a document row.

    Columns ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence),
    ``n_items``, ``items_sha256`` (of the occurring items' ids, sorted as strings
    and comma-joined), ``contaminated`` and the columns ``extra``.  An item of fewer words than a
    window is one window; an item without words, or null, has none.  An item
    without id counts for ``n_hit`` and not for ``n_items``; items that share an
    id are one.  Repeated document rows each give a row.
    """
    windows = item_windows(benchmark, item_id, item_text, window, shingle)
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()] or [shingle]
    grams = window_shingles(windows, sizes).select("hash").distinct()
    small = grams.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    places = staged(shingle_places(docs, doc_id, text, grams, sizes, window, small, extra), "places")
    hits = occurrences(places, prefixes(windows, places, sizes))
    per_doc = hits.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = per_doc.select(F.col("uid").alias("hit_uid"), _covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    rows = places.filter(F.col("hash").isNull()).join(per_doc, F.col("uid") == F.col("hit_uid"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *extra,
    )


#: DuckDB SQL with the rows of :func:`decontaminate`, for distinct ids.
SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT len(win) AS n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
