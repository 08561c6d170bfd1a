"""Row numbers per group without one group in one task.

Rows are range-partitioned and sorted by (group, order), so a large group
spreads over many tasks; a row's number is its offset inside its partition
plus the rows of the same group in earlier partitions (a small table).  The
ranked frame is written once as a table in the session's checkpoint folder,
so every later use sees the same partition ids and the step survives
executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_null_safe


def range_row_numbers(df: DataFrame, group_cols: list[str], order: list[Column],
                      out: str = "row_number", num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` (1, 2, ...) per group in ``order`` (order must be total)."""
    keys = [F.col(c) for c in group_cols] + list(order)
    s = df.repartitionByRange(*([num_partitions] if num_partitions else []), *keys).sortWithinPartitions(*keys) \
        .withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_mid", F.monotonically_increasing_id())
    s = materialize(s, "ranked")
    blocks = s.groupBy("_pid", *group_cols).agg(F.count("*").alias("_c"),
                                                 F.min("_mid").alias("_first"))
    wg = Window.partitionBy(*group_cols).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_c").over(wg), F.lit(0)))
    return join_null_safe(s, blocks.select("_pid", *group_cols, "_before", "_first"),
                          ["_pid", *group_cols]) \
        .withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("bigint")) \
        .drop("_pid", "_mid", "_before", "_first")
