"""Roles and permissions in bulk (IAM-1 .. IAM-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import normalise_role
from ..plans import dimensions as D


def normalise_roles(users: DataFrame) -> DataFrame:
    """IAM-1: user_id, role_raw -> user_id, role (unknown text becomes user)."""
    return users.select("user_id", "role_raw", normalise_role("role_raw").alias("role"))


def acl_decisions(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """IAM-2: every (caller, permission) request is granted or not, with reason.

    ``requests``: request_id, user_id, permission.  ``roles``: user_id, role.
    """
    spark = requests.sparkSession
    rp = D.role_permission(spark).withColumn("held", F.lit(True))
    r = requests.join(roles.select("user_id", "role"), "user_id", "left") \
        .withColumn("role", normalise_role("role"))
    j = r.join(rp, ["role", "permission"], "left")
    granted = F.coalesce(F.col("held"), F.lit(False))
    return j.select(
        *requests.columns, "role", granted.alias("granted"),
        F.when(granted, F.lit("granted"))
         .otherwise(F.concat(F.lit("User "), F.col("user_id"), F.lit(" (role: "),
                             F.col("role"), F.lit(") does not have permission: "),
                             F.col("permission"))).alias("reason"),
    )


def _role_flags(spark, *perms: str) -> DataFrame:
    """One row per role with a boolean column per permission (pivot of 35 rows)."""
    rp = D.role_permission(spark)
    aggs = [F.max(F.col("permission") == p).alias(p) for p in perms]
    return D.bounded_broadcast(rp.groupBy("role").agg(*aggs), len(S.ROLES))


def escalation_view_acl(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """IAM-3: may a caller view tickets of a target user (target may be null)?

    Own target needs view_own_escalations; another target view_all_escalations;
    no target needs either.
    """
    spark = requests.sparkSession
    flags = _role_flags(spark, "view_own_escalations", "view_all_escalations")
    r = requests.join(roles.select("user_id", "role"), "user_id", "left") \
        .withColumn("role", normalise_role("role")).join(flags, "role", "left")
    own, every = F.col("view_own_escalations"), F.col("view_all_escalations")
    tgt = F.col("target_user_id")
    allowed = (F.when(tgt.isNotNull() & (tgt == F.col("user_id")), own)
               .when(tgt.isNotNull(), every)
               .otherwise(own | every))
    return r.select("request_id", "user_id", "role", "target_user_id",
                    F.coalesce(allowed, F.lit(False)).alias("allowed"))


def tool_visibility(spark) -> DataFrame:
    """Static case of IAM-4: role, tool for every tool the role may use."""
    rp, tp = D.role_permission(spark), D.tool_permission(spark)
    return rp.join(tp, "permission").select("role", "tool").distinct()


def tool_counts_by_role(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """IAM-4 per role: how many tools the role sees, how many users hold it, and
    their calls: all, entitled, denied, and distinct tools called.

    One row per fixed role, zeros where nobody holds it; a caller without a user
    row counts as a plain user's call.  ``calls``: call_id, user_id, tool."""
    spark = calls.sparkSession
    sees = D.bounded_broadcast(tool_visibility(spark).groupBy("role").agg(
        F.count("*").alias("tools_visible")), len(S.ROLES))
    users = roles.groupBy(normalise_role("role").alias("role")).agg(F.count("*").alias("users"))
    made = tool_call_entitlement(calls, roles).groupBy("role").agg(
        F.count("*").alias("calls"), F.count_if("entitled").alias("entitled_calls"),
        F.count_if(~F.col("entitled")).alias("denied_calls"),
        F.count_distinct("tool").alias("tools_called"))
    counts = ["users", "calls", "entitled_calls", "denied_calls", "tools_called"]
    return sees.join(users, "role", "left").join(made, "role", "left").select(
        "role", "tools_visible", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def tool_call_entitlement(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """IAM-4: each tool call is entitled if the caller's role holds any
    permission the tool needs.  ``calls``: call_id, user_id, tool."""
    spark = calls.sparkSession
    rp, tp = D.role_permission(spark), D.tool_permission(spark)
    role_tool = D.bounded_broadcast(
        rp.join(tp, "permission").select("role", "tool").distinct()
        .withColumn("entitled", F.lit(True)), len(S.ROLES) * len(S.TOOL_PERMISSIONS))
    c = calls.join(roles.select("user_id", "role"), "user_id", "left") \
        .withColumn("role", normalise_role("role"))
    return c.join(role_tool, ["role", "tool"], "left") \
        .withColumn("entitled", F.coalesce("entitled", F.lit(False)))
