"""Equi-joins that keep rows whose key is null (SQL ``=`` would drop them)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` where a null key equals a null key.

    Null-safe equality is an equi-join condition to Spark (hash or sort-merge
    join, skew handling included)."""
    r = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    cond = reduce(and_, [left[k].eqNullSafe(r[f"_key_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_key_{k}" for k in keys])
