"""Small dimension frames built from the fixed values, and the broadcast rule.

These frames have a size known before any data is read (a few dozen rows), so
broadcasting them is safe at any scale.  Frames derived from data are never
broadcast by hand; Spark's size statistics and AQE decide for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

MAX_BROADCAST_ROWS = 10_000


def bounded_broadcast(df: DataFrame, known_rows: int) -> DataFrame:
    """Broadcast a frame whose row count is known in advance and small; a
    larger one is left to Spark's own choice of join."""
    return F.broadcast(df) if known_rows <= MAX_BROADCAST_ROWS else df


def role_permission(spark: SparkSession) -> DataFrame:
    rows = [(r, p) for r in S.ROLES for p in S.ROLE_PERMISSIONS[r]]
    return bounded_broadcast(
        spark.createDataFrame(rows, "role string, permission string"), len(rows))


def tool_permission(spark: SparkSession) -> DataFrame:
    rows = [(t, p) for t, ps in S.TOOL_PERMISSIONS.items() for p in ps]
    return bounded_broadcast(
        spark.createDataFrame(rows, "tool string, permission string"), len(rows))


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, k, c, sev, a, reg, ex, float(S.SEVERITY_WEIGHT[sev]))
            for (i, k, c, sev, a, reg, ex) in S.RULES]
    return bounded_broadcast(spark.createDataFrame(
        rows, "rule_id string, kind string, category string, severity string, "
              "action string, regulation string, examples array<string>, weight double"),
        len(rows))


def industry_thresholds(spark: SparkSession) -> DataFrame:
    rows = list(S.INDUSTRY_CONFIDENCE)
    return bounded_broadcast(
        spark.createDataFrame(rows, "industry string, threshold double"), len(rows))
