"""Tables written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


#: Lists of the folders that open scopes have staged.
_OPEN: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The written table survives lost executors and cuts the lineage, so rows
    that later steps read several times are computed once.  It stays until its
    :func:`scope` ends, or :func:`release` or the folder's own cleaning removes it.
    """
    return _write(df, name, _OPEN)


def _write(df: DataFrame, name: str, scopes: list[list[str]]) -> DataFrame:
    folder = f"{shared_folder(df.sparkSession)}/tallystream-{uuid.uuid4().hex}"
    for opened in scopes:
        opened.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written and read again; all that it staged on the way is removed."""
    outer = list(_OPEN)
    with scope(spark):
        return _write(make(), "result", outer)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged within it, which must not be read any more."""
    mine: list[str] = []
    _OPEN.append(mine)
    try:
        yield
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not mine]
        for folder in mine:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes every table that :func:`staged` has left in the shared folder; none may be in use."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder):
        for item in fs.listStatus(folder):
            if item.getPath().getName().startswith("tallystream-"):
                fs.delete(item.getPath(), True)
