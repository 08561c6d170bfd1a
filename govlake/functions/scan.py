"""Order-dependent scans per key that do not put one key in one task.

A plain window ``partitionBy(key).orderBy(time)`` sorts and buffers every row
of a key in one task, which fails when one key holds a large share of the
rows.  These helpers cut each key's rows into time buckets: the scan runs
inside each (key, bucket) in parallel, and a small frame with one row per
(key, bucket) carries the state of earlier buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_null_safe


def bucket_of(ts: str, unit: str = "day") -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def last_non_null(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                  bucket: str = "_bucket") -> DataFrame:
    """``out`` = the last non-null ``value`` at or before each row, per key,
    in ``order``.  ``df`` must carry a ``bucket`` column that is monotone in
    the order (e.g. the day of the timestamp)."""
    w_in = Window.partitionBy(*keys, bucket).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn("_in", F.last(value, ignorenulls=True).over(w_in))
    # last non-null value of each bucket: max_by over the ordering
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("_blast"))
    buckets = join_null_safe(df.select(*keys, bucket).distinct(), per, [*keys, bucket], "left")
    w_b = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select(*keys, bucket, F.last("_blast", ignorenulls=True).over(w_b)
                           .alias("_carry"))
    return join_null_safe(x, carry, [*keys, bucket]) \
        .withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop("_in", "_carry")


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                   bucket: str = "_bucket") -> DataFrame:
    """``out`` = ``value`` of the previous row of the same key in ``order``
    (a lag that crosses bucket borders through the last row of the nearest
    earlier bucket)."""
    w_in = Window.partitionBy(*keys, bucket).orderBy(*order)
    x = df.withColumn("_lag", F.lag(value).over(w_in))
    per = df.groupBy(*keys, bucket).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("_blast"))
    w_b = Window.partitionBy(*keys).orderBy(bucket)
    carry = per.select(*keys, bucket, F.lag("_blast").over(w_b).alias("_carry"))
    return join_null_safe(x, carry, [*keys, bucket]) \
        .withColumn(out, F.coalesce(F.col("_lag"), F.col("_carry"))).drop("_lag", "_carry")


def asof_last(left: DataFrame, right: DataFrame, key: str, ts: str, value: str,
              unit: str = "day") -> DataFrame:
    """For each left row, the ``value`` of the newest right row with the same
    key at or before its time (right rows win ties; equal times are ordered
    by value).  An as-of join as one bucketed scan: no pairs are formed."""
    lft = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast("string"))
    rgt = right.select(key, ts, value).withColumn("_side", F.lit(0))
    u = lft.unionByName(rgt, allowMissingColumns=True).withColumn("_bucket", bucket_of(ts, unit))
    r = last_non_null(u, [key], [ts, "_side", value], value, "_asof")
    return r.filter(F.col("_side") == 1).drop(value, "_side", "_bucket") \
        .withColumnRenamed("_asof", value)
