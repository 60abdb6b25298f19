"""Bounded samples that every executor takes part in choosing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the least ids of a label are chosen, so that no task ranks all of a label's.
PARTS = 64


def least_by_hash(ids: DataFrame, label: str, count: int) -> DataFrame:
    """At most about ``count`` rows (``id``, ``mix`` and ``label``) of each label, by the hash of their id.

    A label's ids fall into ``PARTS`` parts by another hash, and each part gives
    an equal share, which each task cuts to before the shuffle.  Labels with few
    ids give all of them, if the parts happen not to run over.
    """
    share = math.ceil(count / PARTS)
    rows = ids.withColumn("mix", F.xxhash64("id")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)))
    rank = Window.partitionBy(label, "part").orderBy("mix", "id")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= share).drop("part", "rank")
