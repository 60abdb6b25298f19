"""Signed webhook requests: signatures as column expressions, verification, and what a status means."""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def signature(secret: bytes, timestamp: Column, delivery_id: Column, attempt: Column, body: Column) -> Column:
    """The version 1 signature of each delivery, in lower-case hexadecimal.

    The keyed hash is two SHA-256 digests over constant pads, so it needs no Python.
    """
    if not secret:
        raise ValueError("a secret is needed")
    key = (hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret).ljust(_BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    text = F.concat_ws("\n", F.lit("v1"), timestamp.cast("string"), delivery_id, attempt.cast("string"), F.sha2(body.cast("binary"), 256))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))), 256)


def verify(secret: bytes, body: bytes, delivery_id: str, attempt: str, timestamp: str, header: str, now_seconds: int, tolerance_seconds: int = 300) -> tuple[str, int, int]:
    """Delivery, attempt and time of a request whose signature holds; anything else raises ValueError."""
    number = r"0|[1-9][0-9]*"
    if not secret or not delivery_id.strip() or not re.fullmatch(number, attempt) or not re.fullmatch(number, timestamp):
        raise ValueError("malformed request")
    if not 1 <= int(attempt) < 2**32 or abs(now_seconds - int(timestamp)) > tolerance_seconds:
        raise ValueError("attempt or time out of bounds")
    if not re.fullmatch("v1=[0-9a-f]{64}", header):
        raise ValueError("malformed signature")
    text = "\n".join(("v1", timestamp, delivery_id, attempt, hashlib.sha256(body).hexdigest()))
    if not hmac.compare_digest(hmac.new(secret, text.encode(), hashlib.sha256).hexdigest(), header[3:]):
        raise ValueError("wrong signature")
    return delivery_id, int(attempt), int(timestamp)


def disposition(status: Column) -> Column:
    """What becomes of a delivery with an HTTP status: acknowledge, retry or reject."""
    return F.when(status.between(200, 299), "acknowledge").when((status == 429) | status.between(500, 599), "retry").otherwise("reject")
