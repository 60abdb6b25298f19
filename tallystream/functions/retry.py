"""Retry delays with deterministic jitter, as column expressions and in Python."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystream.functions import hashes

#: Domain of the jitter of deliveries.
DELIVERY_DOMAIN = "tallystream/delivery-jitter/v1"


@dataclass(frozen=True)
class RetryPolicy:
    """How often, how long and how spread out failed work is retried; times in milliseconds."""

    initial_delay_ms: int = 1_000
    max_delay_ms: int = 60_000
    jitter_percent: int = 10
    max_attempts: int = 8
    exponential: bool = True
    max_age_ms: int | None = None

    def base(self, attempt: int) -> int:
        """The delay after an attempt, counted from 1, without jitter."""
        factor = 2 ** min(max(attempt, 1) - 1, 63) if self.exponential else 1
        return min(self.initial_delay_ms * factor, self.max_delay_ms)

    def _spread(self, base: int, sample: int) -> int:
        span = base * self.jitter_percent // 100
        return base if span == 0 else base - span + sample % (2 * span + 1)

    def message_delay(self, message_id: str, attempt: int) -> int:
        """The delay of a queue message, its jitter from its id."""
        sample = 0
        for byte in message_id.encode():
            sample = (sample * 31 + byte) % 2**64
        return self._spread(self.base(attempt), sample)

    def delivery_delay(self, delivery_id: str, attempt: int) -> int:
        """The delay of a delivery, its jitter from its id and attempt."""
        raw = delivery_id.encode()
        framed = DELIVERY_DOMAIN.encode() + b"\0" + len(raw).to_bytes(8, "big") + raw + attempt.to_bytes(4, "big")
        return self._spread(self.base(attempt), int.from_bytes(hashlib.sha256(framed).digest()[:8], "big"))


def base_delay(attempt: Column, policy: RetryPolicy) -> Column:
    """:meth:`RetryPolicy.base` of a column; the power is bounded so that it can't overflow."""
    if not policy.exponential:
        return F.least(F.lit(policy.initial_delay_ms), F.lit(policy.max_delay_ms)).cast("bigint")
    steps = max(1, (policy.max_delay_ms // max(policy.initial_delay_ms, 1)).bit_length())
    power = F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(steps))).cast("bigint")
    return F.least(F.lit(policy.initial_delay_ms) * power, F.lit(policy.max_delay_ms)).cast("bigint")


def message_delay(message_id: Column, attempt: Column, policy: RetryPolicy) -> Column:
    """:meth:`RetryPolicy.message_delay` of columns."""
    base = base_delay(attempt, policy)
    span = F.floor(base * policy.jitter_percent / 100).cast("bigint")
    return F.when(span == 0, base).otherwise(base - span + hashes.polynomial31_mod(message_id, 2 * span + 1))


def delivery_delay(delivery_id: Column, attempt: Column, policy: RetryPolicy) -> Column:
    """:meth:`RetryPolicy.delivery_delay` of columns."""
    base = base_delay(attempt, policy)
    span = F.floor(base * policy.jitter_percent / 100).cast("bigint")
    raw = F.concat(
        F.encode(F.lit(DELIVERY_DOMAIN), "UTF-8"), F.lit(b"\0"), F.unhex(F.lpad(F.hex(F.octet_length(delivery_id).cast("bigint")), 16, "0")),
        F.encode(delivery_id, "UTF-8"), F.unhex(F.lpad(F.hex(attempt.cast("bigint")), 8, "0")),
    )
    sample = hashes.unsigned(F.sha2(raw, 256), 0)
    return F.when(span == 0, base).otherwise(base - span + (sample % (2 * span + 1).cast("decimal(20,0)")).cast("bigint"))
