"""Globs, names, JSON paths and text and vector similarity as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of text tokens: anything that isn't a letter or number.
SEPARATOR = r"[^\p{L}\p{N}]+"
NAME = r"\A[A-Za-z0-9._-]{1,128}\z"
EARTH_RADIUS_METERS = 6_371_000.0


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``*`` is any run, ``?`` one character, nothing else is special."""
    parts = {"*": ".*", "?": "."}
    return r"(?s)\A" + "".join(parts.get(c) or re.sub(r"([^A-Za-z0-9 ])", r"\\\1", c) for c in pattern) + r"\z"


def glob_matches(value: Column, pattern: str) -> Column:
    """Whether the whole value matches a glob; null doesn't."""
    if not set(pattern) & {"*", "?"}:
        return F.coalesce(value == pattern, F.lit(False))
    if pattern == "*":
        return value.isNotNull()
    if pattern.endswith("*") and not set(pattern[:-1]) & {"*", "?"}:
        return F.coalesce(value.startswith(pattern[:-1]), F.lit(False))
    return F.coalesce(value.rlike(glob_regex(pattern)), F.lit(False))


def any_glob(value: Column, patterns: list[str]) -> Column:
    """Whether any glob matches; no patterns at all pass everything, null included."""
    if not patterns:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [glob_matches(value, p) for p in patterns])


def byte_glob_matches(value: Column, pattern: str) -> Column:
    """As :func:`glob_matches`, but ``?`` is one byte of UTF-8."""
    parts = {"*": "([0-9A-F]{2})*", "?": "[0-9A-F]{2}"}
    body = "".join(parts.get(c) or c.encode().hex().upper() for c in pattern)
    return F.coalesce(F.hex(F.encode(value, "UTF-8")).rlike(rf"\A{body}\z"), F.lit(False))


def valid_name(value: Column) -> Column:
    """Whether a resource name has 1 to 128 of the allowed characters."""
    return F.coalesce(value.rlike(NAME), F.lit(False))


def valid_identifier(value: Column, most: int = 256) -> Column:
    """Whether an identifier isn't blank, isn't too long in bytes, and has no control characters."""
    return F.coalesce((F.trim(value) != "") & (F.octet_length(value) <= most) & ~value.rlike(r"\p{Cntrl}"), F.lit(False))


def json_path(path: str) -> str:
    """The quoted path of dotted object fields; a ``$.`` before them is optional, ``$`` or nothing is the root."""
    path = path.removeprefix("$").removeprefix(".")
    return "$" + "".join(f"['{segment}']" for segment in path.split(".")) if path else "$"


def json_value(payload: Column, path: str) -> Column:
    """The value at a path as canonical JSON text; null if it is missing, ``null`` if it is JSON null."""
    return F.to_json(F.try_variant_get(F.try_parse_json(payload), json_path(path), "variant"))


def json_kind(payload: Column, path: str) -> Column:
    """The type of the value at a path, which tells 42 from 42.0."""
    return F.regexp_replace(F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), json_path(path), "variant")), r"DECIMAL\(\d+,\d+\)", "DECIMAL")


def json_equals(payload: Column, path: str, wanted: str) -> Column:
    """Whether the value at a path equals a JSON text, in value and type."""
    same = json_value(payload, path) == F.to_json(F.parse_json(F.lit(wanted)))
    return F.coalesce(same & (json_kind(payload, path) == json_kind(F.lit(wanted), "$")), F.lit(False))


def tokens(text: Column) -> Column:
    """The distinct lower-cased tokens of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine of an array column and a constant vector, in double precision; 0 for a zero vector."""
    fixed = F.array(*[F.lit(float(x)) for x in b])
    dot = F.aggregate(F.zip_with(a, fixed, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) * float(x) for x in b) ** 0.5
    return F.when((norm == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(dot / (norm * length))


def micro_degrees(degrees: Column) -> Column:
    """Degrees rounded to a millionth, as an integer."""
    return F.round(degrees * 1_000_000).cast("int")


def distance_meters(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Great-circle distance of micro-degree coordinates from a point in degrees."""
    here = (round(lon0 * 1e6) / 1e6, round(lat0 * 1e6) / 1e6)
    north, east = F.radians(lat / 1e6), F.radians(lon / 1e6)
    half = F.pow(F.sin((north - F.radians(F.lit(here[1]))) / 2), 2) + F.cos(north) * F.cos(F.radians(F.lit(here[1]))) * F.pow(F.sin((east - F.radians(F.lit(here[0]))) / 2), 2)
    return 2 * EARTH_RADIUS_METERS * F.asin(F.sqrt(half))
