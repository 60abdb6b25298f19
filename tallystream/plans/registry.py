"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL of the same rows if SQL can express it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def fnv_sql(text: str, n: int) -> str:
    """FNV-1a of an ASCII text modulo ``n``."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::UHUGEINT)"
    return f"(list_reduce(list_prepend(14695981039346656037::UHUGEINT, {codes}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % {n})::INTEGER"


#: The envelope view of events.
ENVELOPES = """
env AS (SELECT event_id, user_id, value, event_id::VARCHAR AS id, 'events' AS source, event_type AS type, date_diff('microsecond', TIMESTAMP '1970-01-01', ts::TIMESTAMP) // 1000 AS time_ms, user_id::VARCHAR AS key,
  't' || (user_id % 3) AS tenant, CASE WHEN event_type <> 'error' THEN props END AS payload, (event_id % 10)::INTEGER AS priority,
  user_id || ':' || event_type AS dedupe_id, CASE WHEN event_id % 7 <> 0 THEN 'tx' || (event_id % 7) END AS transaction_id FROM events)"""
#: Events appended to eight partitions.
RECORDS = (
    ENVELOPES
    + f""",
parts AS (SELECT DISTINCT key, {fnv_sql("key", 8)} AS partition FROM (SELECT DISTINCT key FROM env)),
rec AS (SELECT env.*, partition, time_ms AS appended_at_ms, row_number() OVER (PARTITION BY partition ORDER BY time_ms, event_id) - 1 AS "offset" FROM env JOIN parts USING (key))"""
)
#: Bytes of a record's canonical JSON.
RECORD_BYTES = """(strlen('{"partition":' || partition || ',"offset":' || "offset" || ',"appended_at_ms":' || appended_at_ms || ',"id":"' || id || '","source":"events","type":"' || type || '","time_ms":' || time_ms ||
',"key":"' || key || '","headers":{"tenant":"' || tenant || '"},"content_type":"application/json","priority":' || priority || ',"dedupe_id":"' || dedupe_id || '"' || coalesce(',"transaction_id":"' || transaction_id || '"', '') ||
',"extensions":{}}') + coalesce(strlen(payload) + 11, 0))"""
#: Transactions tx1 to tx6: every third is pending, aborted or committed; tx6 isn't registered.
TRANSACTIONS = "tx AS (SELECT 'tx' || i AS transaction_id, CASE i % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'committed' ELSE 'aborted' END AS status FROM range(1, 6) t(i))"
