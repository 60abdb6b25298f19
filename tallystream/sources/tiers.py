"""Immutable objects of older records, captures, and compressed batches."""

from __future__ import annotations

import base64
import gzip
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COMPRESSED, MAX_EXPANDED = 360 * 1024, 4 * 1024 * 1024
#: Records of a batch at most.
MAX_BATCH = 1_000
#: Offsets of a block of a digest.
BLOCK = 4_096


def write_tier(records: DataFrame, path: str, partition: str = "partition") -> DataFrame:
    """Writes records as Parquet by partition and returns the manifest of the written ranges."""
    records.repartition(partition).sortWithinPartitions(partition, "offset").write.partitionBy(partition).mode("errorifexists").parquet(path)
    rows = records.sparkSession.read.parquet(path)
    return manifest(rows, partition)


def canonical(records: DataFrame) -> Column:
    """JSON of all columns in the order of their names, nulls too; maps are lists of entries in the order of their keys."""
    kinds = dict(records.dtypes)
    parts = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map<") else F.col(c) for c in sorted(records.columns)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def digests(records: DataFrame, partition: str = "partition") -> DataFrame:
    """First and end offset, rows and a SHA-256 digest of each partition's records in offset order.

    The digest is that of the comma-joined digests of blocks of offsets, and a
    block's that of the comma-joined digests of its records, so no task holds
    more than a block, or a partition's blocks.
    """
    rows = records.select(partition, "offset", F.floor(F.col("offset") / BLOCK).alias("_block"), F.sha2(canonical(records), 256).alias("_sha"))
    listed = lambda key, c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), ","), 256)
    blocks = rows.groupBy(partition, "_block").agg(F.min("offset").alias("_first"), F.max("offset").alias("_last"), F.count("*").alias("_n"), listed("offset", "_sha").alias("_digest"))
    return blocks.groupBy(partition).agg(F.min("_first").alias("first_offset"), (F.max("_last") + 1).alias("end_offset"), F.sum("_n").alias("records"), listed("_block", "_digest").alias("digest"))


def manifest(records: DataFrame, partition: str = "partition") -> DataFrame:
    """The :func:`digests` of a tier, whose offsets must differ; one that occurs twice is an error."""
    twice = records.groupBy(F.col(partition).alias("_p"), F.floor(F.col("offset") / BLOCK).alias("_block")).agg((F.count_distinct("offset") < F.count("*")).alias("_twice"))
    twice = twice.groupBy("_p").agg(F.bool_or("_twice").alias("_twice"))
    rows = digests(records, partition).join(twice, F.col(partition).eqNullSafe(F.col("_p")))
    digest = F.when(F.col("_twice"), F.raise_error(F.lit("an offset occurs twice")).cast("string")).otherwise(F.col("digest"))
    return rows.select(partition, "first_offset", "end_offset", "records", digest.alias("digest"))


def verified_tier(spark: SparkSession, path: str, expected: DataFrame, partition: str = "partition") -> DataFrame:
    """Reads a tier whose manifest must be the expected one; a difference raises ValueError."""
    rows = spark.read.parquet(path)
    found = manifest(rows, partition)
    if not found.exceptAll(expected.select(found.columns)).isEmpty() or not expected.select(found.columns).exceptAll(found).isEmpty():
        raise ValueError(f"the tier at {path} isn't what its manifest says")
    return rows


def capture_lines(records: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON line a record, ``line``, beside ``partition`` and ``offset``; a null stays a null."""
    fields = F.concat_ws(",", *[F.concat(F.to_json(F.array(F.lit(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(c)))) - 2), F.lit(":"), _json(records[c])) for c in columns])
    return records.select("partition", "offset", F.concat(F.lit("{"), fields, F.lit("}")).alias("line"))


def capture_array(records: DataFrame, columns: list[str]) -> DataFrame:
    """As :func:`capture_lines`, whose lines in offset order are one JSON array a partition."""
    ends = records.groupBy(F.col("partition").alias("_p")).agg(F.min("offset").alias("_first"), F.max("offset").alias("_last"))
    rows = capture_lines(records, columns).join(ends, F.col("partition") == F.col("_p"))
    before, after = F.when(F.col("offset") == F.col("_first"), "[").otherwise(","), F.when(F.col("offset") == F.col("_last"), "]").otherwise("")
    return rows.select("partition", "offset", F.concat(before, "line", after).alias("line"))


def _json(column: Column) -> Column:
    text = F.to_json(F.array(column))
    return F.when(column.isNull(), F.lit("null")).otherwise(text.substr(F.lit(2), F.length(text) - 2))


def write_capture(records: DataFrame, path: str, columns: list[str], array: bool = False) -> None:
    """Writes records in JSON Lines, or as one JSON array, one folder and file a partition, in offset order."""
    (capture_array if array else capture_lines)(records, columns).repartition("partition").sortWithinPartitions("partition", "offset").select("partition", "line").write.partitionBy("partition").text(path)


def _expand(codec: str, body: bytes) -> bytes:
    if codec == "none":
        return body
    if codec == "gzip":
        return gzip.decompress(body)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(body, max_output_size=MAX_EXPANDED)
    if codec in ("lz4", "snappy"):
        import pyarrow as pa

        return pa.input_stream(pa.BufferReader(body), compression=codec).read() if codec == "lz4" else _unframe_snappy(body)
    raise ValueError(f"unknown codec {codec}")


def _unframe_snappy(body: bytes) -> bytes:
    """The content of a snappy frame: a stream identifier, then compressed and plain chunks."""
    import pyarrow as pa

    snappy, out, at = pa.Codec("snappy"), [], 0
    while at < len(body):
        kind, size = body[at], int.from_bytes(body[at + 1 : at + 4], "little")
        chunk = body[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            length, shift = 0, 0
            for k, b in enumerate(chunk[4:]):
                length |= (b & 127) << shift
                shift += 7
                if b < 128 or k > 4:
                    break
            out.append(bytes(snappy.decompress(chunk[4:], decompressed_size=length)))
        elif kind == 1:
            out.append(chunk[4:])
        elif kind < 128 and kind != 0xFF:
            raise ValueError(f"unknown chunk {kind}")
    return b"".join(out)


def encode_batch(records: list[dict], codec: str = "none") -> str:
    """A batch as base64 of its compressed canonical JSON."""
    body = json.dumps(records, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    if codec == "gzip":
        body = gzip.compress(body, mtime=0)
    elif codec == "zstd":
        import zstandard

        body = zstandard.ZstdCompressor().compress(body)
    elif codec == "lz4":
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(body)
        body = sink.getvalue().to_pybytes()
    elif codec == "snappy":
        import pyarrow as pa

        packed = bytes(pa.Codec("snappy").compress(body))
        body = b"\xff\x06\x00\x00sNaPpY" + b"\x00" + (len(packed) + 4).to_bytes(3, "little") + b"\0\0\0\0" + packed
    elif codec != "none":
        raise ValueError(f"unknown codec {codec}")
    if len(body) > MAX_COMPRESSED:
        raise ValueError("the batch is too large")
    return base64.b64encode(body).decode()


def decode_batch(codec: str, payload: str) -> list[dict]:
    """The records of an encoded batch; anything beyond the bounds raises ValueError."""
    body = base64.b64decode(payload, validate=True)
    if len(body) > MAX_COMPRESSED:
        raise ValueError("the batch is too large")
    whole = _expand(codec, body)
    if len(whole) > MAX_EXPANDED:
        raise ValueError("the expanded batch is too large")
    records = json.loads(whole)
    if not isinstance(records, list) or not 1 <= len(records) <= MAX_BATCH:
        raise ValueError("a batch has 1 to 1000 records")
    sequences = [r.get("client_sequence") for r in records]
    if len(set(sequences)) != len(sequences):
        raise ValueError("a client sequence occurs twice")
    return records


def decoded_batches(batches: DataFrame, codec: str = "codec", payload: str = "payload") -> DataFrame:
    """Batches with ``records`` (their JSON texts) or ``problem``."""

    @F.pandas_udf("records array<string>, problem string")
    def decode(codecs: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for c, p in zip(codecs, payloads, strict=True):
            try:
                rows.append(([json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in decode_batch(c, p)], None))
            except (ValueError, OSError, AttributeError, TypeError) as error:
                rows.append((None, str(error)))
        return pd.DataFrame(rows, columns=["records", "problem"])

    return batches.withColumn("decoded", decode(codec, payload)).select("*", "decoded.*").drop("decoded")
