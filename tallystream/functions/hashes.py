"""Stable hashes as column expressions: routing, identifiers, jitter samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: The 64-bit FNV-1a start value in halves; its prime is 2**40 + 435 (fixed values).
FNV_HIGH, FNV_LOW, FNV_PRIME = 0xCBF29CE4, 0x84222325, 435
TWO_64 = "18446744073709551616"


def utf8_bytes(text: Column) -> Column:
    """The bytes of a string as an array of bigints; characters of ASCII are their own."""
    short = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when((F.octet_length(text) == F.char_length(text)) & (text != ""), short).otherwise(_long_bytes(text))


def _long_bytes(text: Column) -> Column:
    digits = F.hex(F.encode(text, "UTF-8"))
    count = F.octet_length(text)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))


def fnv1a_mod(text: Column, n: int) -> Column:
    """FNV-1a of the UTF-8 bytes, modulo ``n`` below 2**31.

    The state is kept in 32-bit halves, as a 64-bit product would overflow.
    """
    start = F.struct(F.lit(FNV_HIGH).cast("bigint").alias("high"), F.lit(FNV_LOW).cast("bigint").alias("low"))

    def step(state, byte):
        low = state["low"].bitwiseXOR(byte)
        product = low * FNV_PRIME
        high = (state["high"] * FNV_PRIME + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(MASK))
        return F.struct(high.alias("high"), product.bitwiseAND(F.lit(MASK)).alias("low"))

    return F.aggregate(utf8_bytes(text), start, step, lambda s: ((s["high"] % n) * ((1 << 32) % n) + s["low"]) % n).cast("int")


def partition_for(key: Column, record_id: Column, n: int) -> Column:
    """The partition of a record: by its key, or by its id if the key is null or empty."""
    return fnv1a_mod(F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(record_id), n)


def polynomial31_mod(text: Column, n: Column) -> Column:
    """The 64-bit wrapping hash ``h * 31 + byte``, modulo the column ``n`` below 2**31."""
    start = F.struct(F.lit(0).cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("low"))

    def step(state, byte):
        low = state["low"] * 31 + byte
        high = (state["high"] * 31 + F.shiftright(low, 32)).bitwiseAND(F.lit(MASK))
        return F.struct(high.alias("high"), low.bitwiseAND(F.lit(MASK)).alias("low"))

    return F.aggregate(utf8_bytes(text), start, step, lambda s: ((s["high"] % n) * (F.lit(1 << 32) % n) + s["low"]) % n)


def stable_hash(value: Column) -> Column:
    """The first eight bytes of the SHA-256 digest as an unsigned number, ``decimal(20,0)``."""
    return unsigned(F.sha2(value.cast("binary"), 256), 0)


def unsigned(hexadecimal: Column, word: int) -> Column:
    """A 16-digit word of a hexadecimal digest as ``decimal(20,0)``."""
    return F.conv(F.substring(hexadecimal, 16 * word + 1, 16), 16, 10).cast("decimal(20,0)")


def framed_digest(domain: str, *parts: Column) -> Column:
    """SHA-256 (hexadecimal) of a domain, a zero byte, and each part after its length as eight bytes."""
    framed = [F.unhex(F.concat(F.lpad(F.hex(F.octet_length(p).cast("bigint")), 16, "0"), F.hex(F.encode(p, "UTF-8")))) for p in parts]
    return F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.lit(b"\0"), *framed), 256)


def proposal_id(domain: str, *parts: Column) -> Column:
    """A number that identifies a command by its domain and parts, ``decimal(20,0)``."""
    return unsigned(framed_digest(domain, *parts), 0)


def bloom_positions(value: Column, bits: int, hashes: int) -> Column:
    """The bits that a value sets in a Bloom filter: ``(h1 + i * h2) mod 2**64 mod bits`` with odd ``h2``."""
    digest = F.sha2(value.cast("binary"), 256)
    wide = lambda c: c.cast("decimal(38,0)")
    first, second = wide(unsigned(digest, 0)), wide(unsigned(digest, 1))
    odd = second + F.lit(1).cast("decimal(38,0)") - second % F.lit(2).cast("decimal(38,0)")
    modulus, size = F.lit(TWO_64).cast("decimal(38,0)"), F.lit(bits).cast("decimal(38,0)")
    one = lambda i: ((first + odd * F.lit(i).cast("decimal(5,0)")) % modulus % size).cast("int")
    return F.array(*[one(i) for i in range(hashes)])
