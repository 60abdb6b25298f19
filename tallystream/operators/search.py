"""Top-k searches over vectors, texts, places and JSON documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions import matching

MAX_LIMIT = 1_000
MAX_DEPTH, MAX_DOCUMENT_BYTES = 64, 256 * 1024


def _checked(limit: int, most: int = MAX_LIMIT) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"a limit is 1 to {most}")
    return limit


def vector_search(rows: DataFrame, vector: list[float], limit: int, text: str | None = None, weight: float = 1.0, condition: Column | None = None, digits: int = 6) -> DataFrame:
    """The best rows by ``weight * cosine + (1 - weight) * jaccard``, then id; the exact scan of all rows.

    Only each task's best rows are shuffled.
    """
    score = matching.cosine(F.col("vector"), vector) * weight
    found = rows.filter(condition) if condition is not None else rows
    if text is not None:
        found = found.withColumn("_tokens", matching.tokens(F.col("text")))  # a step of its own, so that they are made once
        score = score + matching.jaccard(F.col("_tokens"), _token_array(text)) * (1 - weight)
    return found.withColumn("score", F.round(score, digits)).drop("_tokens").orderBy(F.desc("score"), "id").limit(_checked(limit))


def _token_array(text: str) -> Column:
    wanted = sorted(set(_split(text)))
    return F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")


def _split(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(matching.SEPARATOR, text.lower()) if t]


def text_search(rows: DataFrame, text: str, limit: int, digits: int = 6) -> DataFrame:
    """The rows whose tokens are most similar to those of a text."""
    made = rows.withColumn("_tokens", matching.tokens(F.col("text")))
    scored = made.withColumn("score", F.round(matching.jaccard(F.col("_tokens"), _token_array(text)), digits)).drop("_tokens")
    return scored.orderBy(F.desc("score"), "id").limit(_checked(limit)).filter("score > 0")


def geo_radius(points: DataFrame, lon: float, lat: float, radius: float, limit: int, digits: int = 3) -> DataFrame:
    """Members (``member``, ``lon`` and ``lat`` in micro-degrees) within a radius in meters, the nearest first.

    A bound on the latitude comes before the trigonometry.
    """
    reach = int(radius / 111_000 * 1e6) + 2_000
    here = round(lat * 1e6)
    rows = points.filter(F.col("lat").between(here - reach, here + reach)).withColumn("meters", matching.distance_meters(F.col("lon"), F.col("lat"), lon, lat))
    return rows.filter(F.col("meters") <= radius).orderBy("meters", "member").limit(_checked(limit)).withColumn("meters", F.round("meters", digits))


def json_exact(documents: DataFrame, path: str, value: str, limit: int = 100) -> DataFrame:
    """Documents (``id``, ``payload``) whose value at a path equals a JSON text, by id."""
    return documents.filter(matching.json_equals(F.col("payload"), path, value)).orderBy("id").limit(_checked(limit, 100))


def postings(documents: DataFrame, paths: list[str]) -> DataFrame:
    """The secondary index of JSON paths: ``path``, ``value`` (canonical), ``kind`` and ``id``; missing values have no row."""
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), matching.json_value(F.col("payload"), p).alias("value"), matching.json_kind(F.col("payload"), p).alias("kind")) for p in paths])
    return documents.select("id", F.inline(F.filter(pairs, lambda x: x["value"].isNotNull()))).select("path", "value", "kind", "id")


def pointer_parts(pointer: str) -> list[str]:
    """The segments of a JSON pointer; one that doesn't start with a slash raises ValueError."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"bad pointer {pointer!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def pointer_get(document, pointer: str):
    """The value at a pointer, array places included; KeyError if there is none."""
    for part in pointer_parts(pointer):
        if isinstance(document, dict) and part in document:
            document = document[part]
        elif isinstance(document, list) and part.isascii() and part.isdigit() and (part == "0" or part[0] != "0") and int(part) < len(document):
            document = document[int(part)]
        else:
            raise KeyError(pointer)
    return document


def pointer_set(document, pointer: str, value):
    """The document with a value at a pointer; objects on the way are made, and take the place of scalars."""
    parts = pointer_parts(pointer)
    if not parts:
        return value
    root = document if isinstance(document, dict) else {}
    at = root
    for part in parts[:-1]:
        if not isinstance(at.get(part), dict):
            at[part] = {}
        at = at[part]
    at[parts[-1]] = value
    return root


def pointer_remove(document, pointer: str):
    """The document without the field at a pointer, and whether it was there."""
    parts = pointer_parts(pointer)
    at = document
    for part in parts[:-1]:
        if not isinstance(at, dict) or part not in at:
            return document, False
        at = at[part]
    if not parts or not isinstance(at, dict) or parts[-1] not in at:
        return document, False
    del at[parts[-1]]
    return document, True


def depth(document) -> int:
    """How deep a JSON value is nested; a scalar has depth 1."""
    children = document.values() if isinstance(document, dict) else document if isinstance(document, list) else ()
    return 1 + max(map(depth, children), default=0)


def canonical(document) -> str:
    """JSON with sorted keys and no white space."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def edited(documents: DataFrame, edit: str, pointer: str, value: str | None = None) -> DataFrame:
    """Documents with ``edited``: their payload after a ``set`` or ``remove`` at a pointer, canonical; null if it isn't JSON or too deep or large."""
    pointer_parts(pointer)
    if edit not in ("set", "remove"):
        raise ValueError(f"unknown edit {edit}")

    @F.pandas_udf("string")
    def apply(payloads: pd.Series) -> pd.Series:
        out = []
        for p in payloads:
            try:
                document = json.loads(p) if p is not None else None
                document = pointer_set(document, pointer, json.loads(value or "null")) if edit == "set" else pointer_remove(document, pointer)[0]
                text = canonical(document)
                out.append(text if depth(document) <= MAX_DEPTH and len(text.encode()) <= MAX_DOCUMENT_BYTES else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="string")

    return documents.withColumn("edited", apply("payload"))
