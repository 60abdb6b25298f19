"""Row filters of a fixed size, which spare wide rows a shuffle.

A set of keys of any size is marked in one bitmap of hashes.  Rows whose bit
isn't set can't be in the set; the others, few of them by chance, go through an
exact join.  The bitmap is a table of at most ``BITS / 32768`` rows of 4 KB, so
it can be broadcast whatever the keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm._scratch import staged

#: Bits of a bitmap: 16 MB.
BITS = 1 << 27


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """``rows`` with a flag: false where ``key`` surely isn't in the only column of ``keys``.  A null key is never marked."""
    held = keys.select(_place(F.col(keys.columns[0])).alias("place"), F.col(keys.columns[0]).isNotNull().alias("some")).filter("some")
    bits = held.groupBy(F.bitmap_bucket_number("place").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits"))
    bits = F.broadcast(staged(bits, "bitmap"))
    bit = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.bitmap_bucket_number(F.col("__place")) == F.col("__part")
    found = rows.withColumn("__place", _place(key)).join(bits, on, "left")
    flag = key.isNotNull() & F.coalesce(byte.bitwiseAND(F.pow(F.lit(2.0), bit % 8).cast("int")) != 0, F.lit(False))
    return found.withColumn(name, flag).drop("__place", "__part", "__bits")


def without(rows: DataFrame, key: str, gone: DataFrame, small: int) -> DataFrame:
    """``rows`` whose ``key`` isn't in the only column of ``gone``.

    Up to ``small`` keys are broadcast.  Beyond that only rows that the bitmap
    marks are shuffled.  A null key stays.
    """
    other = gone.columns[0]
    if gone.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(gone), F.col(key) == F.col(other), "left_anti")
    flagged = marked(rows, F.col(key), gone, "__maybe")
    asked = flagged.filter("__maybe").join(gone.hint("merge"), F.col(key) == F.col(other), "left_anti")
    return flagged.filter("NOT __maybe").unionByName(asked).drop("__maybe")


def within(rows: DataFrame, key: str, wanted: DataFrame, other: str, small: int) -> DataFrame:
    """The inner join of ``rows`` and ``wanted`` where ``key`` equals ``other``; beyond ``small`` only rows that the bitmap marks are shuffled."""
    on = F.col(key) == F.col(other)
    if wanted.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(wanted), on)
    return marked(rows, F.col(key), wanted.select(other), "__maybe").filter("__maybe").drop("__maybe").join(wanted.hint("merge"), on)


#: Keys that a join may treat as heavy; each holds more than one part in this many of all rows.
HEAVY = 1_000


def by_weight(rows: DataFrame, key: str, side: DataFrame, other: str, weight: str, total: int) -> DataFrame:
    """The left join of ``rows`` and ``side`` where ``key`` equals ``other``, of which ``side`` has one row a value.

    ``weight`` is how many of the ``total`` rows have the value.  The values with
    more than ``total / HEAVY`` of them, so fewer than ``HEAVY`` values, are
    broadcast, and no key of the shuffled join holds more than that share.  Rows
    without key have no match and stay out of the shuffle.
    """
    on = F.col(key) == F.col(other)
    heavy = side.filter(F.col(weight) * HEAVY > total)
    keyed = rows.filter(F.col(key).isNotNull())
    hot = keyed.join(F.broadcast(heavy), on)
    cold = keyed.join(F.broadcast(heavy.select(other)), on, "left_anti").join(side, on, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields]
    return hot.unionByName(cold).unionByName(rows.filter(F.col(key).isNull()).select("*", *none)).drop(weight)


#: Parts into which the rows of a heavy key are dealt.
SALTS = 64


def salted(rows: DataFrame, key: str, side: DataFrame, other: str, weight: str, total: int, by: Column) -> DataFrame:
    """The inner join of ``rows`` and ``side`` where ``key`` equals ``other``; ``side`` may have several rows a value.

    ``weight`` is how many of the ``total`` rows have the value.  The rows of
    the values with more than ``total / HEAVY`` of them, so fewer than ``HEAVY``
    values, are dealt over ``SALTS`` parts by the hash ``by``, and the side's
    rows of these values stand in each.
    """
    heavy = F.col(weight) * HEAVY > total
    known = F.broadcast(side.filter(heavy).select(F.col(other).alias("__heavy")).distinct())
    mine = rows.join(known, F.col(key) == F.col("__heavy"), "left")
    mine = mine.withColumn("__salt", F.when(F.col("__heavy").isNotNull(), F.pmod(by, F.lit(SALTS))).otherwise(0).cast("int")).drop("__heavy")
    parts = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other_side = side.withColumn("__part", F.explode(parts))
    return mine.join(other_side, (F.col(key) == F.col(other)) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__part", weight)
