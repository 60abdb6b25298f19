"""What a user may bring: a clock, and a log of committed commands."""

from __future__ import annotations

import time
import zlib
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@runtime_checkable
class Clock(Protocol):
    """Tells the time in milliseconds."""

    def now_ms(self) -> int: ...


@runtime_checkable
class CommitLog(Protocol):
    """Keeps commands under dense numbers from 0 on."""

    def append(self, commands: list[str]) -> int:
        """The number of the first one."""

    def read(self, since: int) -> DataFrame:
        """Commands from a number on (``index``, ``command``), in order."""


class SystemClock:
    """The machine's time."""

    def now_ms(self) -> int:
        return time.time_ns() // 1_000_000


class FixedClock:
    """A time that only moves when it is told to, never back."""

    def __init__(self, now_ms: int = 0):
        self._now = now_ms

    def now_ms(self) -> int:
        return self._now

    def advance(self, ms: int) -> None:
        """Moves on."""
        if ms < 0:
            raise ValueError("time doesn't go back")
        self._now += ms


class ParquetLog:
    """A commit log of Parquet files, a checksum with each command; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "index long, command string, crc long")
        return self.spark.read.schema("index long, command string, crc long").parquet(self.path)

    def append(self, commands: list[str]) -> int:
        first = self._rows().agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
        rows = [(first + k, c, zlib.crc32(c.encode())) for k, c in enumerate(commands)]
        if rows:
            self.spark.createDataFrame(rows, "index long, command string, crc long").coalesce(1).write.mode("append").parquet(self.path)
        return first

    def read(self, since: int) -> DataFrame:
        """Commands from a number on; a damaged one is an error when it is read."""
        whole = F.crc32(F.col("command").cast("binary")) == F.col("crc")
        command = F.when(whole, F.col("command")).otherwise(F.raise_error(F.concat(F.lit("damaged command "), F.col("index").cast("string"))))
        return self._rows().filter(F.col("index") >= since).select("index", command.alias("command")).orderBy("index")
