"""Running totals and dense numbers that no single task computes for a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a bucket within which rows of a key are sorted, where they are numbered and not timed.
PER_BUCKET = 1 << 24
#: The bucket of rows without a number, which come first.
FIRST = -(1 << 62)


def number_bucket(order: str, per_bucket: int | None) -> Column:
    """The bucket of a row by its number; all have one where ``per_bucket`` is None."""
    return F.lit(0) if per_bucket is None else F.coalesce(F.floor(F.col(order) / per_bucket), F.lit(FIRST))


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], bucket: Column | None = None, newest_first: bool = False) -> DataFrame:
    """Adds a column for each of ``values``: its sum over the rows of a key up to each row.

    ``order`` must be total within a key.  With ``bucket``, which must not
    decrease along the first column of ``order``, rows are only sorted within
    their bucket and the totals of earlier buckets are added, so a large key is
    spread over tasks; the totals read ``df`` once more, in their columns only,
    and rows with a null key or bucket have none.  Without it a key is one task's.
    """
    if not values:
        return df
    by = [F.col(c).desc() if newest_first else F.col(c).asc() for c in order]
    if bucket is None:
        window = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(window).alias(c) for c, v in values.items()])
    rows = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_total_{c}") for c, v in values.items()])
    step = F.col("_bucket").desc() if newest_first else F.col("_bucket").asc()
    across = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_total_{c}").over(across), F.lit(0)).alias(f"_before_{c}") for c in values])
    joined = rows.select("*", *[F.sum(v).over(local).alias(f"_local_{c}") for c, v in values.items()]).join(before, [*keys, "_bucket"], "left")
    summed = joined.select("*", *[(F.col(f"_local_{c}") + F.col(f"_before_{c}")).alias(c) for c in values])
    return summed.drop("_bucket", *[f"_local_{c}" for c in values], *[f"_before_{c}" for c in values])


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column | None = None, newest_first: bool = False) -> DataFrame:
    """:func:`running_totals` of one value."""
    return running_totals(df, keys, order, {out: value}, bucket, newest_first)


def dense_number(df: DataFrame, keys: list[str], order: list[str], out: str, start: int = 0, bucket: Column | None = None) -> DataFrame:
    """Adds ``out``, the place of each row within its key from ``start`` on."""
    numbered = running_total(df, keys, order, F.lit(1), out, bucket)
    return numbered.withColumn(out, (F.col(out) - 1 + start).cast("bigint"))


def carried(df: DataFrame, keys: list[str], order: str, value: Column, out: str, per_bucket: int | None, latest: bool = False, inclusive: bool = False) -> DataFrame:
    """Adds ``out``: the largest ``value`` among the rows of a key before each row, or with ``latest`` that of the row just before.

    With ``inclusive`` the row itself counts too.  ``order`` is a number that is
    total within a key; of a null key only rows of the same bucket count.  Rows
    are only sorted within buckets of ``per_bucket`` numbers; what earlier buckets
    end with is added from a table of one row a key and bucket, which costs a
    second scan.  With None, for keys that are all small, a key is one task's.
    """
    held = F.struct(value.alias("v")) if latest else value
    rows = df.withColumn("_carried_held", held).withColumn("_bucket", number_bucket(order, per_bucket))
    pick = F.last if latest else F.max
    local = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("_carried_inside", pick("_carried_held").over(local))
    if per_bucket is None:
        found = F.col("_carried_inside")
    else:
        # From the same columns only, so that the second scan stays narrow.
        ends = df.select(*keys, number_bucket(order, per_bucket).alias("_bucket"), held.alias("_carried_held"), F.col(order).alias("_carried_at"))
        ends = ends.groupBy(*keys, "_bucket").agg((F.max_by("_carried_held", F.coalesce("_carried_at", F.lit(FIRST))) if latest else F.max("_carried_held")).alias("_carried_end"))
        across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(ends.select(*keys, "_bucket", pick("_carried_end").over(across).alias("_carried_before")), [*keys, "_bucket"], "left")
        found = F.coalesce("_carried_inside", "_carried_before") if latest else F.greatest("_carried_inside", "_carried_before")
    return rows.withColumn(out, found["v"] if latest else found).drop("_carried_held", "_bucket", "_carried_inside", "_carried_before")


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each non-null key, and all rows without a key.

    Rows of a key are cut to the first of each task before the shuffle.
    """
    rank = Window.partitionBy(key).orderBy(*order)
    keyed = df.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
    return keyed.unionByName(df.filter(F.col(key).isNull()))


def as_of(rows: DataFrame, at: str, changes: DataFrame, changed_at: str, value: str, bucket_ms: int) -> DataFrame:
    """Adds ``value``: that of the last change up to each row's time ``at``, null before any.

    Of changes at one time the largest value is the last.  Both sides are put
    together and only sorted within buckets of time; the last change of earlier
    buckets is added from a table of one row a bucket.
    """
    kind = changes.schema[value].dataType
    mine = rows.withColumn("_at", F.col(at)).withColumn("_value", F.lit(None).cast(kind))
    theirs = changes.filter(F.col(changed_at).isNotNull()).select(F.col(changed_at).cast(rows.schema[at].dataType).alias("_at"), F.col(value).alias("_value"), F.lit(True).alias("_change"))
    both = mine.withColumn("_change", F.lit(False)).unionByName(theirs, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket_ms))
    local = Window.partitionBy("_bucket").orderBy("_at", F.desc("_change"), "_value").rowsBetween(Window.unboundedPreceding, 0)
    last = both.groupBy("_bucket").agg(F.max(F.when(F.col("_change"), F.struct("_at", "_value"))).alias("_end"))
    across = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    before = last.select(F.col("_bucket").alias("_b"), F.last("_end", ignorenulls=True).over(across)["_value"].alias("_before"))
    found = both.withColumn("_inside", F.last("_value", ignorenulls=True).over(local)).filter(~F.col("_change"))
    out = found.join(before, F.col("_bucket") == F.col("_b"), "left").withColumn(value, F.coalesce("_inside", "_before"))
    return out.drop("_at", "_value", "_change", "_bucket", "_inside", "_b", "_before")
