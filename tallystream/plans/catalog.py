"""All registered queries of the event-log engine and their SQL."""

from __future__ import annotations

from tallystream.plans import bus_queries, fold_queries, lookup_queries, state_queries, stream_queries  # noqa: F401
from tallystream.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
