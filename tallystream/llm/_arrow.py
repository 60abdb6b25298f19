"""Helpers for operators that work on Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a kernel sees, unless a single row is longer.
PIECE_BYTES = 1 << 19
#: Bytes of an Arrow batch between an executor and its Python worker, and Spark's setting for them.
BATCH_BYTES = 1 << 21
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 26


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64), raw[offsets[0] : offsets[-1]]


def _give_back() -> None:
    """Returns a worker's free memory to the system, as the worker stays for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def give_back_heap(spark: SparkSession) -> None:
    """Lets executors collect their garbage and return free heap to the system, for what runs beside the heap.

    A heap that one step has made large otherwise stays so for all later ones.
    There is a task for each core; an executor that gets none keeps its heap.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).collect()


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with smaller batches than Spark's.

    Both sides hold a batch several times over, beside the executor's heap, and
    texts gain nothing from large ones.  A setting that isn't Spark's default is
    left as it is.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    conf = df.sparkSession.conf
    if (conf.get(_SETTING, None) or "").rstrip("bB") == str(_DEFAULT):
        conf.set(_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``limit`` bytes of text each."""
    offsets, _ = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: list[T.StructField],
    kernel: Callable[[], Callable[[pa.Array], list]],
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the columns that a kernel computes from ``text``.

    ``kernel()`` runs once in each task and returns a function from an Arrow
    array of texts to one Arrow-compatible list for each of ``fields``.
    """
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *fields])
    types = [pa_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = kernel()
        for batch in batches:
            for part in pieces(batch, k, limit):
                out = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(compute(part.column(k)), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *out], names)

    return arrow_map(chosen, run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few Spark types that kernels return."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, pa_type(f.dataType)) for f in kind.fields])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
    }[type(kind)]
