"""Reading the audit log: filters, summaries, tail, projections.

FLT-1..5, AGG-1..3, WIN-1, TOP-1, TOP-2, PRJ-1, PRJ-2, PRJ-4.
Event order is (timestamp, event_id) where the reference uses file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import normalise_role, shorten, truncate
from ..plans import dimensions as D


def _order_cols(df: DataFrame) -> list[str]:
    return ["timestamp"] + (["event_id"] if "event_id" in df.columns else [])


def filter_user(events: DataFrame, user_id: str) -> DataFrame:
    """FLT-1."""
    return events.filter(F.col("user_id") == user_id)


def filter_action(events: DataFrame, text: str) -> DataFrame:
    """FLT-2: action contains the text; a missing action is the empty text."""
    return events.filter(F.coalesce(F.col("action"), F.lit("")).contains(text))


def filter_event(events: DataFrame, event_type: str) -> DataFrame:
    """FLT-3."""
    return events.filter(F.col("event_type") == event_type)


def filter_combined(events: DataFrame, user_id=None, action=None, event_type=None,
                    date=None) -> DataFrame:
    """FLT-4: the conjunction of the given filters (None = no filter)."""
    out = events
    if date is not None:
        out = out.filter(F.to_date("timestamp") == F.lit(date).cast("date"))
    if user_id:
        out = filter_user(out, user_id)
    if action:
        out = filter_action(out, action)
    if event_type:
        out = filter_event(out, event_type)
    return out


def failures(events: DataFrame) -> DataFrame:
    """FLT-5: failed events, or events whose action mentions failed/error."""
    a = F.coalesce(F.col("action"), F.lit(""))
    return events.filter(~F.coalesce(F.col("success"), F.lit(True))
                         | a.contains("failed") | a.contains("error"))


def summary(events: DataFrame) -> DataFrame:
    """AGG-1: total, successes, failures (missing success counts as success)."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    return events.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"),
                      F.count_if(~ok).alias("failure"))


def counts_by(events: DataFrame, col: str) -> DataFrame:
    """AGG-2 / AGG-3: counts per value (missing is ``unknown``), largest first."""
    k = F.coalesce(F.col(col), F.lit("unknown")).alias(col)
    return events.groupBy(k).agg(F.count("*").alias("n")) \
        .orderBy(F.col("n").desc(), F.col(col))


def tail(events: DataFrame, n: int) -> DataFrame:
    """WIN-1, global: the last ``n`` events (top-k, no full sort)."""
    if n <= 0:
        return events
    order = [F.col(c).desc() for c in _order_cols(events)]
    return events.orderBy(*order).limit(n)


def tail_per_user(events: DataFrame, n: int) -> DataFrame:
    """WIN-1, per user: the last ``n`` events of every user."""
    w = Window.partitionBy("user_id").orderBy(*[F.col(c).desc() for c in _order_cols(events)])
    return events.withColumn("pos", F.row_number().over(w).cast("bigint")) \
        .filter(F.col("pos") <= n)


def recent_audit(events: DataFrame, roles: DataFrame, caller_id: str,
                 limit: int = S.RECENT_AUDIT_DEFAULT, event_type: str | None = None) -> DataFrame:
    """TOP-1: newest ``min(limit, 200)`` events, optionally of one type, for a
    caller holding view_logs (otherwise no rows).

    The permission is an EXISTS subquery on the caller's role, so the plan
    has no join at all."""
    spark = events.sparkSession
    n = min(int(limit), S.RECENT_AUDIT_CAP)
    held = D.role_permission(spark).filter(F.col("permission") == "view_logs")
    caller = roles.filter(F.col("user_id") == caller_id) \
        .select(normalise_role("role").alias("role")).join(held, "role", "left_semi")
    ev = events if event_type is None else filter_event(events, event_type)
    return tail(ev, n).filter(caller.exists())


def top_counts(events: DataFrame, col: str, n: int = 10, alias: str | None = None) -> DataFrame:
    """TOP-2: the ``n`` most frequent values of ``col``, ties by value."""
    name = alias or col
    return events.groupBy(F.col(col).alias(name)).agg(F.count("*").alias("n")) \
        .orderBy(F.col("n").desc(), F.col(name)).limit(n)


def compact(events: DataFrame) -> DataFrame:
    """PRJ-1: time HH:mm:ss, status mark, event type, user, action."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    return events.select(
        *(["event_id"] if "event_id" in events.columns else []),
        F.date_format("timestamp", "HH:mm:ss").alias("time"),
        F.when(ok, F.lit("✓")).otherwise(F.lit("✗")).alias("mark"),
        F.coalesce("event_type", F.lit("unknown")).alias("event_type"),
        F.coalesce("user_id", F.lit("unknown")).alias("user_id"),
        F.coalesce("action", F.lit("unknown")).alias("action"))


def _dget(path: str, typ: str = "string") -> Column:
    return F.try_variant_get(F.col("details"), path, typ)


def verbose(events: DataFrame) -> DataFrame:
    """PRJ-2: the detail fields the log viewer shows, shortened like it.

    ``events`` from ``read_audit`` (``details`` is VARIANT).  The error is
    read from the event's top level and from details."""
    score = _dget("$.analysis.safety_score", "double")
    rules = F.try_variant_get(F.col("details"), "$.analysis.violated_rules", "array<string>")
    return events.select(
        "timestamp", "event_type", "user_id", "action",
        shorten(_dget("$.input"), 100).alias("input"),
        score.alias("safety_score"),
        F.when(score >= 0.8, "green").when(score >= 0.5, "yellow")
         .when(score.isNotNull(), "red").alias("safety_band"),
        F.when(F.size(rules) > 0, F.array_join(rules, ", ")).alias("violated"),
        shorten(_dget("$.analysis.analysis"), 120).alias("analysis"),
        _dget("$.decision.action").alias("decision"),
        shorten(_dget("$.decision.reasoning"), 120).alias("reasoning"),
        shorten(_dget("$.summary"), 120).alias("summary"),
        _dget("$.transaction_id").alias("transaction_id"),
        _dget("$.amount", "decimal(18,2)").alias("amount"),
        _dget("$.from_account").alias("from_account"),
        _dget("$.to_account").alias("to_account"),
        F.coalesce(F.col("error"), _dget("$.error")).alias("error"))


def field_truncation(texts: DataFrame, text_col: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """PRJ-4: every truncation limit of the reference applied to one text."""
    return texts.select(*keys, *[truncate(text_col, n).alias(name)
                                 for name, n in S.TRUNCATE.items()])
