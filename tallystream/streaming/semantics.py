"""What a sink promises about each record, and sinks that keep the promise."""

from __future__ import annotations

from collections.abc import Callable
from enum import StrEnum

from pyspark.sql import DataFrame

STAGING = "_staging"


class Delivery(StrEnum):
    """How often a record of a stream reaches its target."""

    AT_MOST_ONCE = "at_most_once"
    AT_LEAST_ONCE = "at_least_once"
    EFFECTIVELY_ONCE = "effectively_once"
    TRANSACTIONAL = "transactional"


def batch_writer(target: str, delivery: Delivery) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes Parquet below ``target``.

    A batch may come again after a failure.  At most once: its number is noted
    before it is written, and a noted one is skipped, so a batch that failed
    half-way is lost.  At least once: it is appended again.  Effectively once:
    its folder is replaced.  Transactional: it is written aside and its folder
    moved into place in one step, so readers see all of a batch or none.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        fs = place("x").getFileSystem(conf)
        folder = f"batch={number}"
        if delivery == Delivery.AT_MOST_ONCE:
            if fs.createNewFile(place(f"_begun-{number}")):
                batch.write.mode("append").parquet(f"{target}/{folder}")
        elif delivery == Delivery.AT_LEAST_ONCE:
            batch.write.mode("append").parquet(f"{target}/{folder}")
        elif delivery == Delivery.EFFECTIVELY_ONCE:
            batch.write.mode("overwrite").parquet(f"{target}/{folder}")
        elif not fs.exists(place(folder)):
            batch.write.mode("overwrite").parquet(f"{target}/{STAGING}-{number}")
            if not fs.rename(place(f"{STAGING}-{number}"), place(folder)):
                raise OSError(f"{folder} can't be moved into place")

    return write
