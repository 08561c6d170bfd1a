"""Exact percentiles without holding a group in one task.

Spark's ``percentile`` aggregate keeps every value of a group in one buffer.
Here equal values are counted first (partial aggregation, so a hot value is
one row), the distinct values are range-partitioned by (group, value), so a
large group spreads over many tasks, and each value's ranks follow from a
running count in its partition plus the counts of the same group in earlier
partitions (a small table).  The values at the needed ranks are interpolated
as ``quantile_cont`` does: h = (n - 1) * p between ranks floor(h) and ceil(h).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_null_safe


def exact_percentiles(df: DataFrame, group_cols: list[str], value_col: str,
                      ps: list[float], names: list[str] | None = None,
                      num_partitions: int | None = None, digits: int = 6) -> DataFrame:
    names = names or [f"p{int(round(p * 100))}" for p in ps]
    counts = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")) \
        .filter(F.col("_v").isNotNull()).groupBy(*group_cols, "_v").agg(F.count("*").alias("_k"))
    s = counts.repartitionByRange(*([num_partitions] if num_partitions else []), *group_cols, "_v") \
        .withColumn("_pid", F.spark_partition_id())
    # Written once to the shared checkpoint folder, so both uses below see the
    # same partition ids (and survive executor loss).
    s = materialize(s, "quantile-input")
    wg = Window.partitionBy(*group_cols)
    blocks = s.groupBy("_pid", *group_cols).agg(F.sum("_k").alias("_c")) \
        .withColumn("_before", F.coalesce(F.sum("_c").over(
            wg.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_n", F.sum("_c").over(wg)).drop("_c")
    w_in = Window.partitionBy("_pid", *group_cols).orderBy("_v") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = join_null_safe(s.withColumn("_upto", F.sum("_k").over(w_in)), blocks,
                            ["_pid", *group_cols]) \
        .withColumn("_end", F.col("_before") + F.col("_upto"))      # ranks [_end - _k, _end)

    def at(rank):
        return F.max(F.when((rank >= F.col("_end") - F.col("_k")) & (rank < F.col("_end")),
                            F.col("_v")))

    aggs = []
    for p, name in zip(ps, names):
        h = (F.col("_n") - 1) * F.lit(p)
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
    g = ranked.groupBy(*group_cols).agg(F.first("_n").alias("_n"), *aggs)
    out = []
    for p, name in zip(ps, names):
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.round(lo + (h - F.floor(h)) * (hi - lo), digits).alias(name))
    return g.select(*group_cols, F.col("_n").alias("n"), *out)
