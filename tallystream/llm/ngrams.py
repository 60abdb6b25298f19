"""A modified Kneser-Ney model of byte n-grams, kept and joined as a table.

Bytes are taken as they are.  The model is a table with one row an n-gram of up
to ``ORDER`` bytes that trusted text holds, so it grows with that text.  It is
counted and joined in shards and never brought to the driver, which only gets
the counts of counts of each order.

Documents lie in chunks, runs of rows of a partition.  The n-grams of a chunk,
each once, are joined with the table, and what is found is streamed in front of
the chunk's texts.  The texts are read twice, so the input must give the same
rows in the same order when it is read again, as a scan of files does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm._arrow import arrow_map, pa_type, pieces, utf8
from tallystream.llm._scratch import staged

ORDER = 5
#: Bytes of text that one call of a kernel sees, and after which a chunk ends.
WINDOW, CHUNK_BYTES = 1 << 19, 1 << 26
#: Distinct n-grams that a task holds before it hands on counts, or sorts anew.
HELD = 1 << 19
_SHIFT = 8 * ORDER


def windows(texts: pa.Array):
    """The n-gram that ends at each byte, and the row of each; line ends stand before each text."""
    offsets, raw = utf8(texts)
    lengths = np.diff(offsets)
    back = ORDER - 1
    for at in range(0, len(raw), WINDOW if len(lengths) == 1 else max(len(raw), 1)):
        if len(lengths) == 1:
            part = raw[max(at - back, 0) : at + WINDOW]
            s = np.concatenate((np.full(max(back - at, 0), 10, np.uint8), part)).astype(np.int64)
            place = np.arange(back, len(s))
            owner = np.zeros(len(place), np.int64)
        else:
            owner = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(raw)) + back * (owner + 1)
            s = np.full(len(raw) + back * len(lengths), 10)
            s[place] = raw
        code = np.zeros(max(len(s) - back, 0), np.int64)
        for k in range(ORDER):
            code = code << 8 | s[k : len(s) - back + k]
        yield code[place - back], owner


def key(order: int, gram):
    """The key of an n-gram of ``order`` bytes; works on arrays and columns."""
    return gram + (order << _SHIFT)


def wanted(grams: np.ndarray) -> np.ndarray:
    """Keys of what the probabilities of n-grams of the full order need: all lower orders, and the contexts."""
    out = [np.array([key(0, 0)])]
    for k in range(ORDER, 0, -1):
        grams = np.unique(grams & ((1 << 8 * k) - 1))
        out += [key(k, grams), key(k - 1, grams >> 8)]
    return np.unique(np.concatenate(out))


def counts(texts: DataFrame) -> DataFrame:
    """``g`` and ``n``: the n-grams of the full order in a column of texts, and how often they occur."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, at = np.unique(g, return_inverse=True)
            return found, np.bincount(at, n, len(found)).astype(np.int64)

        for batch in batches:
            for part in pieces(batch, 0, WINDOW):
                for grams, _ in windows(part.column(0)):
                    held.append(np.unique(grams, return_counts=True))
                    size += len(held[-1][0])
                    if size > 2 * HELD:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["g", "n"])
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["g", "n"])

    return arrow_map(texts, run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(seen: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and from 3 on, from how many n-grams occur 1 to 4 times."""
    y = seen[0] / (seen[0] + 2 * seen[1]) if seen[0] else 0.5
    return [min(max(k + 1 - (k + 2) * y * seen[k + 1] / seen[k], 0.1), k + 0.9) if seen[k] else 0.5 for k in range(3)]


def model(texts: DataFrame) -> DataFrame:
    """Staged, one row an n-gram of any order up to ``ORDER``, or the context of one, in the texts.

    ``num`` is its discounted count, and as a context ``tot`` has the sum of
    the counts that follow it and ``held`` that of their discounts.  Counts of
    lower orders are of the distinct bytes before.
    """
    level = staged(counts(texts), "grams")
    levels = [level.select(F.lit(ORDER).alias("k"), "g", "n")]
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count("*").alias("n"))
        levels.append(level.select(F.lit(k).alias("k"), "g", "n"))
    table = levels[0]
    for x in levels[1:]:
        table = table.unionByName(x)
    table = staged(table, "orders")
    seen = {(r.k, r.n): r.found for r in table.filter("n <= 4").groupBy("k", "n").agg(F.count("*").alias("found")).collect()}
    less = F.lit(0.0)
    for k in range(1, ORDER + 1):
        one, two, more = discounts([seen.get((k, n), 0) for n in range(1, 5)])
        less = F.when(F.col("k") == k, F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)).otherwise(less)
    table = table.withColumn("less", less)
    unit, zero = F.lit(1 << _SHIFT), F.lit(0.0)
    own = table.select((F.col("g") + F.col("k") * unit).alias("key"), (F.col("n") - F.col("less")).alias("num"), zero.alias("tot"), zero.alias("held"))
    context = table.select((F.shiftright("g", 8) + (F.col("k") - 1) * unit).alias("key"), zero.alias("num"), F.col("n").cast("double").alias("tot"), F.col("less").alias("held"))
    sums = [F.sum(c).alias(c) for c in ("num", "tot", "held")]
    return staged(own.unionByName(context).groupBy("key").agg(*sums).select("key", *[F.col(c).cast("float").alias(c) for c in ("num", "tot", "held")]), "model")


def losses(grams: np.ndarray, keys: np.ndarray, num: np.ndarray, tot: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Negative log-probability of n-grams of the full order, from the table's rows, sorted by key."""

    def look(order, gram):
        want = key(order, gram)
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        return at, keys[at] == want

    p = np.full(len(grams), 1 / 256)
    if len(keys):
        for k in range(1, ORDER + 1):
            gram = grams & ((1 << 8 * k) - 1)
            at, found = look(k, gram)
            mine = np.where(found, num[at], 0)
            at, found = look(k - 1, gram >> 8)
            total = np.where(found, tot[at], 0)
            safe = np.maximum(total, 1)
            p = np.where(total > 0, mine / safe + held[at] / safe * p, p)
    return -np.log(np.maximum(p, 1e-12))


def _chunks(batches):
    """Pieces of a partition's batches with the chunk of each: the partition and how many chunks it has before.

    The partition is the first column, as a task's own number is another one where tables are put together.
    """
    size = 0
    for batch in batches:
        last = batch.num_columns - 1
        for part in pieces(batch, last, WINDOW):
            yield part.column(0)[0].as_py() << 20 | size // CHUNK_BYTES, part.select(range(1, last + 1))
            offsets, _ = utf8(part.column(last))
            size += int(offsets[-1])


def scores(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs``, whose last column is the text, with ``n_bytes`` and ``loss`` in place of it; one row a row."""
    last, fields = len(docs.columns) - 1, docs.schema.fields[:-1]

    def distinct(batches):
        chunk, held, size = None, [], 0
        for of, part in _chunks(batches):
            if chunk is not None and of != chunk:
                yield from handed(chunk, held)
                held, size = [], 0
            chunk = of
            for grams, _ in windows(part.column(last)):
                held.append(np.unique(grams))
                size += len(held[-1])
                if size > 2 * HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0]) if len(held[0]) < HELD else HELD
        if chunk is not None:
            yield from handed(chunk, held)

    def handed(chunk, held):
        want = wanted(np.unique(np.concatenate(held))) if held else np.zeros(0, np.int64)
        for at in range(0, len(want), 1 << 16):
            some = want[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some)], ["chunk", "key"])

    def bodies(batches):
        for chunk, part in _chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

    numbered = docs.select(F.spark_partition_id().cast("long").alias("__at"), *docs.columns)
    asked = arrow_map(numbered, distinct, "chunk long, key long")
    found = asked.join(table.hint("merge"), "key").select("chunk", "key", "num", "tot", "held", F.lit(None).cast("binary").alias("body"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("num", "float"), ("tot", "float"), ("held", "float"))]
    texts = arrow_map(numbered, bodies, "chunk long, body binary").select("chunk", *nothing, "body")
    parts = max(1, 2 * docs.rdd.getNumPartitions())
    both = found.unionByName(texts).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("key").asc_nulls_last())
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("loss", T.DoubleType())])
    kinds, names = [pa_type(f.dataType) for f in fields], [f.name for f in schema.fields]

    def run(batches):
        chunk, rows, ready = None, [], None
        for batch in batches:
            of = batch.column(0).to_numpy()
            text = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (text[1:] != text[:-1])))) if len(of) else []
            for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True):
                if of[a] != chunk:
                    chunk, rows, ready = of[a], [], None
                if not text[a]:
                    rows.append([batch.column(c).slice(a, b - a).to_numpy() for c in range(1, 5)])
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
                    rows = []
                for body in batch.column(5).slice(a, b - a):
                    for part in pa.ipc.open_stream(body.as_buffer()):
                        offsets, _ = utf8(part.column(last))
                        total = np.zeros(part.num_rows)
                        for grams, owner in windows(part.column(last)):
                            some, at = np.unique(grams, return_inverse=True)
                            total += np.bincount(owner, losses(some, *ready)[at], part.num_rows)
                        cols = [c.cast(t) for c, t in zip(part.columns[:last], kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offsets)), pa.array(total)], names)

    return arrow_map(both, run, schema)
