"""Connected components of a link table by alternating large and small stars.

Every round is a groupBy with partial aggregation and an equi-join, written to
the shared checkpoint folder; only two numbers per round reach the driver.  A
hub's rows are split by AQE's skew join (its side of the join is the edge
list, the other side has one row per node).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.session import drop_scratch, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return (both.join(low, "u").filter("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    far = down.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that occurs in ``links`` with another one;
    component is the smallest id reachable.  Links may repeat, point either
    way or to themselves; links with a null end are ignored."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while True:
        # the large star as a plan, the small star on top of it: one job
        new = materialize(_small_star(_large_star(edges)), "stars")
        new_state = _state(new)
        drop_scratch(edges)
        edges = new
        if new_state == state:
            break
        state = new_state
    low = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(low)
