"""Cardinality, bitmap and membership sketches."""

from __future__ import annotations

import hashlib
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions import hashes

#: Bias factors of small register counts (fixed values).
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}
MAX_BITMAP_BITS = 1_048_576


def register_of(value: Column, precision: int) -> tuple[Column, Column]:
    """The register that a value falls into and the rank that it sets there.

    The low bits of the stable hash choose the register; the rank is one more
    than the leading zeros of the rest, within its own width.
    """
    h = hashes.stable_hash(value)
    size = F.lit(1 << precision).cast("decimal(20,0)")
    register = (h % size).cast("int")
    rest = F.floor(h / size).cast("decimal(20,0)")
    width = 64 - precision
    bits = F.length(F.regexp_replace(F.conv(rest.cast("string"), 10, 2), "^0+", ""))
    return register, (F.lit(width) - bits + 1).cast("int")


def registers(df: DataFrame, value: Column, precision: int, by: list[str]) -> DataFrame:
    """The registers of a sketch of each group: columns ``by``, ``register`` and ``rank``.

    At most ``2**precision`` rows a group leave each task.
    """
    register, rank = register_of(value, precision)
    return df.select(*by, register.alias("register"), rank.alias("rank")).groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def estimate(table: DataFrame, precision: int, by: list[str]) -> DataFrame:
    """Columns ``by`` and ``estimate``, the rounded cardinality of each group's registers."""
    m = 1 << precision
    alpha = ALPHA.get(m, 0.7213 / (1 + 1.079 / m))
    sums = table.groupBy(*by).agg(F.count("*").alias("filled"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("sum"))
    zeros = F.lit(m) - F.col("filled")
    raw = F.lit(alpha * m * m) / (F.col("sum") + zeros)
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.greatest(zeros, F.lit(1)))
    return sums.select(*by, F.round(F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)).cast("bigint").alias("estimate"))


def bitmap_counts(df: DataFrame, bit: Column, by: list[str]) -> DataFrame:
    """Columns ``by`` and ``bits_set``, by bitmaps of 32,768-bit buckets.

    A bit outside the bounds is an error.
    """
    checked = F.when((bit >= 0) & (bit < MAX_BITMAP_BITS), bit).otherwise(F.raise_error(F.lit("bit outside the bitmap")).cast("bigint"))
    place = checked.cast("bigint") + 1  # positions count from one in each bucket
    rows = df.select(*by, F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    parts = rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    return parts.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias("bits_set"))


def bloom_filter(df: DataFrame, value: Column, bits: int, count: int) -> DataFrame:
    """The distinct set bits (``bit``) of a Bloom filter over all values."""
    if not (64 <= bits <= 8_388_608 and 1 <= count <= 16):
        raise ValueError("a filter has 64 to 8,388,608 bits and 1 to 16 hashes")
    return df.select(F.explode(hashes.bloom_positions(value, bits, count)).alias("bit")).distinct()


def bloom_contains(df: DataFrame, value: Column, bloom: DataFrame, bits: int, count: int) -> DataFrame:
    """The rows of ``df`` and ``maybe``, whether the filter holds their value.

    A filter has a bounded number of bits, so it is broadcast, as one array of words.
    """
    word = F.floor(F.col("bit") / 32).cast("int")
    words = bloom.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 32).cast("int"))).alias("mask"))
    packed = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))
    place = hashes.bloom_positions(value, bits, count)

    def is_set(b: Column) -> Column:
        held = F.try_element_at("words", F.floor(b / 32).cast("int"))
        return F.coalesce(F.call_function("shiftright", held, (b % 32).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    return df.crossJoin(F.broadcast(packed)).withColumn("maybe", F.forall(place, is_set)).drop("words")


@dataclass
class CuckooFilter:
    """A cuckoo filter; a value that finds both buckets full takes the place of an entry at the start of the shortest way to room."""

    buckets: int = 32
    slots: int = 4
    table: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        if self.buckets < 2 or self.buckets & (self.buckets - 1) or self.slots < 1:
            raise ValueError("buckets must be a power of two and slots positive")
        self.table = self.table or [[] for _ in range(self.buckets)]

    def _places(self, value: bytes) -> tuple[int, int, int]:
        digest = hashlib.sha256(value).digest()
        mark = int.from_bytes(digest[8:10], "big") or 1
        first = int.from_bytes(digest[:8], "big") % self.buckets
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ int.from_bytes(hashlib.sha256(mark.to_bytes(2, "big")).digest()[:8], "big") % self.buckets

    def add(self, value: bytes) -> bool:
        """Whether the value was new; a full filter raises OverflowError and stays as it was."""
        mark, first, second = self._places(value)
        if mark in self.table[first] or mark in self.table[second]:
            return False
        path = self._path_to_room((first, second))
        if path is None:
            raise OverflowError("the filter is full")
        # From the free place back, each entry on the way moves on, and the value takes the first one's place.
        for (bucket, moving), (following, _) in zip(reversed(path[:-1]), reversed(path[1:]), strict=True):
            self.table[bucket].remove(moving)
            self.table[following].append(moving)
        self.table[path[0][0]].append(mark)
        return True

    def _path_to_room(self, starts: tuple[int, int]) -> list[tuple[int, int]] | None:
        """The shortest way to a bucket with room, as buckets and the entry that moves on from each; None if there is none.

        Buckets are searched breadth first, entries in the order of their marks, so the way depends on the table only.
        """
        reached: dict[int, tuple[int, int] | None] = dict.fromkeys(starts)
        queue = deque(reached)
        while queue:
            at = queue.popleft()
            if len(self.table[at]) < self.slots:
                path, back = [(at, 0)], reached[at]
                while back is not None:
                    path.append(back)
                    back = reached[back[0]]
                return path[::-1]
            for moving in sorted(set(self.table[at])):
                following = self._other(at, moving)
                if following not in reached:
                    reached[following] = (at, moving)
                    queue.append(following)
        return None

    def contains(self, value: bytes) -> bool:
        """Whether the value may have been added."""
        mark, first, second = self._places(value)
        return mark in self.table[first] or mark in self.table[second]

    def delete(self, value: bytes) -> bool:
        """Removes one entry of the value, if there is one."""
        mark, first, second = self._places(value)
        for bucket in (first, second):
            if mark in self.table[bucket]:
                self.table[bucket].remove(mark)
                return True
        return False
