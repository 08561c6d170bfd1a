"""Row visibility and access outcomes in bulk (ACC-1 .. ACC-7).

The reference decides one caller's call at a time: the role name ``user``
limits a caller to rows they own, every other role sees all rows.  Here a
frame of callers (or of requests) is answered in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ts_ntz

from ..functions.text import normalise_role
from ..plans import dimensions as D
from .. import schemas as S


def roles_seeing_all(permission: str) -> str:
    """The roles that see every row (all but ``user``) and hold ``permission``,
    comma-joined in the fixed order."""
    return ",".join(r for r in S.ROLES if r != "user" and permission in S.ROLE_PERMISSIONS[r])


def visible_rows(data: DataFrame, owner_col: str, roles: DataFrame, permission: str) -> DataFrame:
    """Who may see each row of ``data``, for every caller at once.

    Every row is kept once with ``own_caller`` (its owner, where the owner is
    a known caller of role ``user``; null otherwise) and ``seen_by_roles`` (the
    roles that see every row).  The output grows with the rows, not with rows
    times callers; ``rows_of`` gives one caller's listing from it."""
    held = "user" if permission in S.ROLE_PERMISSIONS["user"] else None
    own = roles.filter(normalise_role("role") == F.lit(held)) \
        .select(F.col("user_id").alias("own_caller"))
    return data.join(own, F.col(owner_col) == F.col("own_caller"), "left") \
        .withColumn("seen_by_roles", F.lit(roles_seeing_all(permission)))


def rows_of(visible: DataFrame, caller_id: str, caller_role: str) -> DataFrame:
    """The rows of ``visible_rows`` one caller sees: a filter, no join."""
    if caller_role == "user":
        seen = F.col("own_caller") == caller_id
    else:
        seen = F.array_contains(F.split("seen_by_roles", ","), caller_role)
    return visible.filter(seen).drop("own_caller", "seen_by_roles")


def visible_accounts(accounts: DataFrame, roles: DataFrame) -> DataFrame:
    """ACC-2: accounts with the callers who may list them."""
    return visible_rows(accounts, "user_id", roles, "view_accounts")


def txn_lookback(transactions: DataFrame, as_of, days: int) -> DataFrame:
    """FLT-6: transactions with ``timestamp >= as_of - days`` (no upper bound).

    ``as_of`` is a literal, so the bound is pushed into the Parquet scan."""
    lo = ts_ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return transactions.filter(F.col("timestamp") >= lo)


def visible_transactions(transactions: DataFrame, accounts: DataFrame, roles: DataFrame,
                         as_of, days: int) -> DataFrame:
    """ACC-3: transactions with the callers who may see them through account
    ownership, with lookback.  Reading needs view_accounts (the permission the
    reference checks, K4)."""
    t = txn_lookback(transactions, as_of, days)
    owned = t.join(accounts.select("account_id", F.col("user_id").alias("owner_id")),
                   "account_id")
    return visible_rows(owned, "owner_id", roles, "view_accounts")


def visible_tickets(tickets: DataFrame, roles: DataFrame, status: str | None = None) -> DataFrame:
    """ACC-4 (with FLT-7): tickets with the callers who may list them, optional status."""
    t = tickets if status is None else tickets.filter(F.col("status") == status)
    return visible_rows(t, "user_id", roles, "view_own_escalations")


def account_access_outcome(requests: DataFrame, roles: DataFrame, accounts: DataFrame,
                           permission: str = "view_accounts") -> DataFrame:
    """ACC-1: every (request_id, caller_id, account_id) gets an outcome.

    Order as the reference: permission, existence, owner.  Outcomes:
    ok / denied_permission / not_found / denied_owner.  The account's columns
    are kept (null unless ok)."""
    spark = requests.sparkSession
    held = D.role_permission(spark).filter(F.col("permission") == permission) \
        .select(F.col("role").alias("caller_role"), F.lit(True).alias("has_perm"))
    r = requests.join(roles.select(F.col("user_id").alias("caller_id"), "role"),
                      "caller_id", "left") \
        .withColumn("caller_role", normalise_role("role")).drop("role") \
        .join(held, "caller_role", "left")
    a = accounts.select("account_id", F.col("user_id").alias("owner_id"),
                        "account_type", "balance", "status")
    j = r.join(a, "account_id", "left")
    outcome = (F.when(F.col("has_perm").isNull(), "denied_permission")
               .when(F.col("owner_id").isNull(), "not_found")
               .when((F.col("caller_role") == "user") & (F.col("owner_id") != F.col("caller_id")),
                     "denied_owner")
               .otherwise("ok"))
    ok = outcome == "ok"
    return j.select(
        *[c for c in requests.columns],
        "caller_role", outcome.alias("outcome"),
        F.when(ok, F.col("owner_id")).alias("owner_id"),
        F.when(ok, F.col("account_type")).alias("account_type"),
        F.when(ok, F.col("balance")).alias("balance"),
        F.when(ok, F.col("status")).alias("account_status"),
    )


def transfer_pair_join(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """ACC-5: attach source and target account (owner, balance) to requests."""
    a = accounts.select("account_id", "user_id", "balance")
    src = a.select(F.col("account_id").alias("from_account_id"),
                   F.col("user_id").alias("src_owner"), F.col("balance").alias("src_balance"))
    dst = a.select(F.col("account_id").alias("to_account_id"),
                   F.col("user_id").alias("dst_owner"), F.col("balance").alias("dst_balance"))
    return requests.join(src, "from_account_id", "left").join(dst, "to_account_id", "left")


def audit_ticket_match(audit_events: DataFrame, tickets: DataFrame) -> DataFrame:
    """ACC-6: ticket events of the audit log against the ticket table.

    ``audit_events`` carry ``ticket_id`` for escalation_created and
    escalation_resolved events.  Output per ticket id: whether a create event,
    a resolve event and a ticket exist, and the mismatch kind."""
    ev = audit_events.filter(F.col("ticket_id").isNotNull()) \
        .groupBy("ticket_id").agg(
            F.count_if(F.col("event_type") == "escalation_created").alias("n_created"),
            F.count_if(F.col("event_type") == "escalation_resolved").alias("n_resolved"))
    t = tickets.select(F.col("id").alias("ticket_id"), "status")
    j = ev.join(t, "ticket_id", "full")
    created = F.coalesce(F.col("n_created"), F.lit(0)) > 0
    resolved = F.coalesce(F.col("n_resolved"), F.lit(0)) > 0
    has_ticket = F.col("status").isNotNull()
    issue = (F.when(~has_ticket, "event_without_ticket")
             .when(~created, "ticket_without_create_event")
             .when((F.col("status") == "resolved") & ~resolved, "resolved_without_event")
             .when((F.col("status") != "resolved") & resolved, "event_without_resolution")
             .otherwise("ok"))
    return j.select("ticket_id", created.alias("has_create_event"),
                    resolved.alias("has_resolve_event"), has_ticket.alias("has_ticket"),
                    issue.alias("issue"))


def is_leg(c: str | Column) -> Column:
    """Whether an id ends like a leg's; the pattern is only asked where no plain ending decides."""
    x = F.col(c) if isinstance(c, str) else c
    return F.endswith(x, F.lit("_from")) | F.endswith(x, F.lit("_to")) | x.rlike("_(from|to)$")


def leg_stem(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.endswith(x, F.lit("_from")), F.left(x, F.char_length(x) - 5)) \
        .when(F.endswith(x, F.lit("_to")), F.left(x, F.char_length(x) - 3)) \
        .otherwise(F.regexp_replace(x, "_(from|to)$", ""))


def transfer_leg_match(legs: DataFrame) -> DataFrame:
    """ACC-7: both legs of every transfer exist and sum to zero.

    One aggregation per id stem (no self-join, no pairs)."""
    t = legs.filter(is_leg("transaction_id"))
    g = t.groupBy(leg_stem("transaction_id").alias("transfer_id")).agg(
        F.count_if(F.col("transaction_id").endswith("_from")).alias("n_from"),
        F.count_if(F.col("transaction_id").endswith("_to")).alias("n_to"),
        F.sum("amount").cast("decimal(38,2)").alias("net_amount"))
    status = (F.when((F.col("n_from") == 1) & (F.col("n_to") == 1) & (F.col("net_amount") == 0), "ok")
              .when((F.col("n_from") == 0) | (F.col("n_to") == 0), "missing_leg")
              .when((F.col("n_from") > 1) | (F.col("n_to") > 1), "duplicate_leg")
              .otherwise("unbalanced"))
    return g.withColumn("status", status)
