"""Balances, transaction history and transfers (LED-1 .. LED-7).

Money is DECIMAL(18,2), so every sum is exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.joins import join_null_safe
from ..functions.text import normalise_role, signed_amount
from ..plans import dimensions as D
from ..session import materialize
from .access import txn_lookback


def user_total_balance(accounts: DataFrame) -> DataFrame:
    """LED-1: number of accounts and total balance per user."""
    return accounts.groupBy("user_id").agg(
        F.count("*").alias("n_accounts"),
        F.sum("balance").cast("decimal(38,2)").alias("total_balance"))


def recent_transactions(transactions: DataFrame, as_of, days: int = S.HISTORY_DAYS,
                        n: int = S.HISTORY_ROWS) -> DataFrame:
    """LED-2: the ``n`` newest transactions per account within the lookback,
    type in upper case, and how many more there are (``remaining``).

    The rank uses ``row_number`` alone in its window, so Spark puts a partial
    per-group limit before the shuffle; the count is a separate partial
    aggregation.  Neither needs all rows of a busy account in one buffer.
    Ties on timestamp are broken by transaction_id."""
    t = txn_lookback(transactions, as_of, days)
    w = Window.partitionBy("account_id").orderBy(F.col("timestamp").desc(),
                                                 F.col("transaction_id").desc())
    top = t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    counts = t.groupBy("account_id").agg(F.count("*").alias("n_in_window"))
    return top.join(counts, "account_id").select(
        "account_id", F.col("rank").cast("bigint").alias("rank"), "transaction_id", "timestamp",
        F.upper("transaction_type").alias("type_label"), "amount", "description",
        F.greatest(F.col("n_in_window") - n, F.lit(0)).alias("remaining"))


# Outcome codes of a transfer request, in the order they are tested.
TRANSFER_OUTCOMES = ["invalid_amount", "denied_permission", "access_denied_source",
                     "access_denied_target", "source_not_found", "target_not_found",
                     "not_own_source", "not_own_target", "same_account",
                     "insufficient_funds", "ok"]


def transfer_precheck(requests: DataFrame, roles: DataFrame, accounts: DataFrame) -> DataFrame:
    """LED-3: outcome of every transfer request against opening balances.

    ``requests``: requester_id, from_account_id, to_account_id, amount, ...
    Order of the tests follows the reference: amount > 0; the two account
    reads (permission, and for role ``user`` ownership of an existing account);
    both accounts exist; both owned by the requester; then funds.  A transfer
    to the same account is refused (the reference double-counts it)."""
    from .access import transfer_pair_join
    spark = requests.sparkSession
    held = D.role_permission(spark).filter(F.col("permission") == "view_accounts") \
        .select(F.col("role").alias("requester_role"), F.lit(True).alias("has_perm"))
    r = requests.join(_telling_roles(roles), "requester_id", "left") \
        .withColumn("requester_role", normalise_role("role")).drop("role") \
        .join(held, "requester_role", "left")
    j = transfer_pair_join(r, accounts)
    me, is_user = F.col("requester_id"), F.col("requester_role") == "user"
    src_o, dst_o = F.col("src_owner"), F.col("dst_owner")
    outcome = (F.when(F.col("amount").isNull() | (F.col("amount") <= 0), "invalid_amount")
               .when(F.col("has_perm").isNull(), "denied_permission")
               .when(is_user & src_o.isNotNull() & (src_o != me), "access_denied_source")
               .when(is_user & dst_o.isNotNull() & (dst_o != me), "access_denied_target")
               .when(src_o.isNull(), "source_not_found")
               .when(dst_o.isNull(), "target_not_found")
               .when(src_o != me, "not_own_source")
               .when(dst_o != me, "not_own_target")
               .when(F.col("from_account_id") == F.col("to_account_id"), "same_account")
               .when(F.col("src_balance") < F.col("amount"), "insufficient_funds")
               .otherwise("ok"))
    return j.withColumn("outcome", outcome).drop("has_perm")


def _telling_roles(roles: DataFrame) -> DataFrame:
    """(requester_id, role) without the users that a left join need not meet: a
    user without a row has the role ``user`` too, so one row saying so tells
    nothing.  Written out: of a known size, it is mostly small beside the requests."""
    r = roles.select(F.col("user_id").alias("requester_id"), "role").filter(F.col("user_id").isNotNull())
    telling = r.groupBy("requester_id").agg(
        F.count("*").alias("_n"), F.count_if(normalise_role("role") != "user").alias("_other")) \
        .filter((F.col("_n") > 1) | (F.col("_other") > 0)).select("requester_id")
    return materialize(r.join(telling, "requester_id", "left_semi"), "roles")


def _fold_schema():
    return ("l_orderkey long, l_linenumber int, requested_at timestamp_ntz, "
            "requester_id string, from_account_id string, to_account_id string, "
            "amount decimal(18,2), status string, src_cents_after long, dst_cents_after long")


def _fold_partition(batches):
    """Sequential transfer fold over rows sorted by (owner, time).

    State is the balance (in cents) of each account of the current owner; it
    is reset when the owner changes, so memory is bounded by one owner's
    accounts, and batches are streamed, so a busy owner is never held whole.
    The request's own columns pass through as they came (Arrow)."""
    import pyarrow as pa
    own = ["l_orderkey", "l_linenumber", "requested_at", "requester_id", "from_account_id", "to_account_id", "amount"]
    owner, bal = None, {}
    for batch in batches:
        status, src_after, dst_after = [], [], []
        rows = zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in (
            "requester_id", "from_account_id", "to_account_id", "src_cents", "dst_cents", "amount_cents")))
        for who, frm, to, s0, d0, amt in rows:
            if who != owner:
                owner, bal = who, {}
            s = bal.get(frm, s0)
            d = bal.get(to, d0)
            if s >= amt:
                s, d = s - amt, d + amt
                status.append("accepted")
            else:
                status.append("insufficient_funds")
            bal[frm], bal[to] = s, d
            src_after.append(s)
            dst_after.append(d)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in own), pa.array(status, pa.string()),
             pa.array(src_after, pa.int64()), pa.array(dst_after, pa.int64())],
            names=[*own, "status", "src_cents_after", "dst_cents_after"])


def _cents(c: str):
    return (F.col(c) * 100).cast("bigint")


def _owner_pieces(live: DataFrame) -> DataFrame:
    """(requester_id, account, _day, net, out, start): the effects of a day on
    an account if every request is accepted, the money that leaves it, and its
    balance when the day begins."""
    w = Window.partitionBy("requester_id", "account").orderBy("_day") \
        .rowsBetween(Window.unboundedPreceding, -1)
    pieces = _effects(live, []).groupBy("requester_id", "account", "_day").agg(
        F.sum("delta").alias("net"), F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)).alias("out"),
        F.max("opening").alias("opening"))
    return pieces.withColumn("start", F.col("opening") + F.coalesce(F.sum("net").over(w), F.lit(0)))


def _effects(live: DataFrame, cols: list[str]) -> DataFrame:
    """Both accounts of each request with the change it makes if accepted."""
    legs = F.array(*(F.struct(F.col(a).alias("account"), d.alias("delta"), F.col(o).alias("opening"))
                     for a, d, o in (("from_account_id", -F.col("amount_cents"), "src_cents"),
                                     ("to_account_id", F.col("amount_cents"), "dst_cents"))))
    return live.select("requester_id", "_day", *cols, F.explode(legs).alias("leg")) \
        .select("requester_id", "_day", *cols, "leg.*")


def _apply_paid_days(live: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """The requests of busy owners: (accepted ones of days that can pay for
    everything, the others with the balances their first day begins with)."""
    pieces = materialize(_owner_pieces(live), "pieces")
    short = pieces.filter(F.col("start") < F.col("out")).groupBy("requester_id").agg(F.min("_day").alias("_short"))
    live = live.join(short, "requester_id", "left")
    paid = F.col("_short").isNull() | (F.col("_day") < F.col("_short"))

    # days that can pay for everything: prefix sums
    w = Window.partitionBy("requester_id", "account", "_day").orderBy(*REQUEST_ORDER, "_row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    legs = _effects(live.filter(paid), ["_row", *[c for c in cols if c != "requester_id"]])
    legs = legs.withColumn("_local", F.sum("delta").over(w)) \
        .join(pieces.select("requester_id", "account", "_day", "start"), ["requester_id", "account", "_day"]) \
        .withColumn("after", F.col("start") + F.col("_local"))
    accepted = legs.groupBy("_row", *cols).agg(
        F.max(F.when(F.col("delta") < 0, F.col("after"))).alias("src_cents_after"),
        F.max(F.when(F.col("delta") > 0, F.col("after"))).alias("dst_cents_after")) \
        .select(*cols, F.lit("accepted").alias("status"), "src_cents_after", "dst_cents_after")

    # the rest of an owner's requests in order, from the balances at that day's beginning
    begun = pieces.join(short, "requester_id").groupBy("account").agg(
        (F.max("opening") + F.sum(F.when(F.col("_day") < F.col("_short"), F.col("net")).otherwise(0)))
        .alias("cents"))
    rest = live.filter(~paid)
    for account, cents in (("from_account_id", "src_cents"), ("to_account_id", "dst_cents")):
        rest = rest.drop(cents).join(begun.select(F.col("account").alias(account), F.col("cents").alias(cents)),
                                     account)
    return accepted, rest


#: Requests of an owner from which on they are summed up by day before any is folded.
BUSY_REQUESTS = 50_000


def transfer_apply(prechecked: DataFrame, num_partitions: int | None = None,
                   busy_requests: int = BUSY_REQUESTS) -> DataFrame:
    """LED-4: apply transfers in request order; later requests see earlier
    balances.

    Both accounts of a request that passes the stateless tests of LED-3 belong
    to the requester, so owners are independent.  An owner of up to
    ``busy_requests`` is folded in order as a whole.  The requests of a busier one
    are summed up per account and day first.  As long as an owner's accounts can pay all that
    leaves them on a day from what they hold when it begins, every request of
    that day is accepted, and its balances are prefix sums: inside a day by a
    window, across days by the summaries, in balanced tasks however many
    requests an owner has.  From the owner's first day that may run short on,
    requests are folded too (in REQUEST_ORDER), streamed through mapInArrow
    with the balances of that owner's accounts in memory.  Rows refused by a
    stateless test pass by with their outcome."""
    cols = ["l_orderkey", "l_linenumber", "requested_at", "requester_id", "from_account_id",
            "to_account_id", "amount"]
    rows = prechecked.select(
        *cols, "outcome",
        F.coalesce(_cents("src_balance"), F.lit(0)).alias("src_cents"),
        F.coalesce(_cents("dst_balance"), F.lit(0)).alias("dst_cents"))
    # the requests with a number each (identical ones stay apart), computed once
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "requests").withColumns({
        "amount_cents": F.coalesce(_cents("amount"), F.lit(0)),
        "_day": F.coalesce(F.to_date("requested_at"), F.lit("0001-01-01").cast("date"))})
    reached = F.col("outcome").isin("ok", "insufficient_funds")
    no_balance = F.lit(None).cast("bigint")
    refused = rows.filter(~reached).select(*cols, F.col("outcome").alias("status"),
                                           no_balance.alias("src_cents_after"), no_balance.alias("dst_cents_after"))
    live = rows.filter(reached).drop("outcome")
    busy = live.groupBy("requester_id").count().filter(F.col("count") > busy_requests)
    busy = materialize(busy.select("requester_id"), "busy")     # one row per busy_requests at most
    folding = [*cols, "src_cents", "dst_cents", "amount_cents"]
    if busy.isEmpty():
        accepted, ordered = None, live.select(*folding)
    else:
        accepted, rest = _apply_paid_days(live.join(busy, "requester_id", "left_semi"), cols)
        ordered = live.join(busy, "requester_id", "left_anti").select(*folding).unionByName(rest.select(*folding))
    ordered = ordered.repartition(*([num_partitions] if num_partitions else []), "requester_id") \
        .sortWithinPartitions("requester_id", *REQUEST_ORDER)
    out = refused.unionByName(ordered.mapInArrow(_fold_partition, _fold_schema()))
    if accepted is not None:
        out = out.unionByName(accepted)

    def money(c: str):
        return (F.col(c).cast("decimal(20,0)") / 100).cast(S.MONEY)

    return out.select(*cols, "status", money("src_cents_after").alias("src_balance_after"),
                      money("dst_cents_after").alias("dst_balance_after"))


def final_balances(applied: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances after LED-4: opening balance plus accepted effects."""
    acc = applied.filter(F.col("status") == "accepted")
    eff = acc.select(F.col("from_account_id").alias("account_id"), (-F.col("amount")).alias("d")) \
        .unionByName(acc.select(F.col("to_account_id").alias("account_id"),
                                F.col("amount").alias("d")))
    delta = eff.groupBy("account_id").agg(F.sum("d").alias("delta"))
    return accounts.select("account_id", "user_id", "balance").join(delta, "account_id", "left") \
        .select("account_id", "user_id", F.col("balance").alias("opening_balance"),
                (F.col("balance") + F.coalesce("delta", F.lit(0))).cast(S.MONEY)
                .alias("closing_balance"))


def transfer_id(*cols: str):
    """Repeatable transfer id from the request's natural key."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256),
                       1, 32)


# A transfer request's natural key: all of its fields (line keys repeat in
# the input, so they alone do not identify a request).
REQUEST_KEY = ("l_orderkey", "l_linenumber", "requested_at", "from_account_id",
               "to_account_id", "amount")
# Total order in which requests are applied.
REQUEST_ORDER = ("requested_at", "l_orderkey", "l_linenumber", "from_account_id",
                 "to_account_id", "amount")


def transfer_legs(accepted: DataFrame, key_cols=REQUEST_KEY,
                  description_col: str | None = None) -> DataFrame:
    """LED-5: each accepted transfer becomes two signed rows ``<id>_from`` and
    ``<id>_to``."""
    a = accepted.withColumn("_tid", transfer_id(*key_cols))
    frm, to = F.col("from_account_id"), F.col("to_account_id")
    default = F.concat(F.lit("Transfer from "), frm, F.lit(" to "), to)
    desc = F.coalesce(F.col(description_col), default) if description_col else default
    legs = F.array(
        F.struct(F.concat(F.col("_tid"), F.lit("_from")).alias("transaction_id"),
                 frm.alias("account_id"), (-F.col("amount")).alias("amount"),
                 F.concat(F.lit("Transfer to "), to, F.lit(": "), desc).alias("description")),
        F.struct(F.concat(F.col("_tid"), F.lit("_to")).alias("transaction_id"),
                 to.alias("account_id"), F.col("amount").alias("amount"),
                 F.concat(F.lit("Transfer from "), frm, F.lit(": "), desc).alias("description")))
    return a.select(F.explode(legs).alias("leg"), "requested_at", "from_account_id",
                    "to_account_id").select(
        "leg.transaction_id", "leg.account_id", F.lit("transfer").alias("transaction_type"),
        F.col("leg.amount").cast(S.MONEY).alias("amount"), F.lit("USD").alias("currency"),
        "leg.description", F.col("requested_at").alias("timestamp"),
        F.lit("completed").alias("status"), "from_account_id", "to_account_id")


def high_value_transfers(transfers: DataFrame, accounts: DataFrame,
                         threshold=S.HIGH_VALUE_AMOUNT) -> DataFrame:
    """LED-6: transfers whose amount exceeds the COMP-004 bound (in either
    direction) become pending review tickets for the account owner.

    ``transfers``: transaction_id, account_id, amount, timestamp."""
    t = transfers.filter(F.abs(F.col("amount")) > F.lit(threshold)) \
        .join(accounts.select("account_id", F.col("user_id").alias("owner_id")), "account_id")
    return t.select(
        F.concat(F.lit("hv-"), F.col("transaction_id")).alias("ticket_id"),
        F.col("owner_id").alias("user_id"), "transaction_id", "account_id", "amount",
        F.concat(F.lit("Transfer of $"), F.abs(F.col("amount")).cast("string"),
                 F.lit(" on account "), F.col("account_id")).alias("input_text"),
        F.lit("COMP-004: transfer over $10,000 requires human review").alias("agent_reasoning"),
        F.lit(1.0).alias("confidence"), F.col("timestamp").alias("created_at"),
        F.lit("pending").alias("status"))


def account_running_balance(transactions: DataFrame, bucket: str = "hour") -> DataFrame:
    """LED-7: signed effect and running sum per account in time order.

    A two-level prefix sum, so a busy account is not one window task, nor a busy
    month of it: rows are cut into (account, hour) pieces; each piece gets a local
    running sum, and the totals of earlier pieces of the same account (one
    row per hour, a small window: 61,000 rows in seven years) are added.  Order: timestamp, then
    transaction_id."""
    t = transactions.select("account_id", "transaction_id", "timestamp", "transaction_type",
                            "amount", "status",
                            signed_amount("transaction_type", "amount").alias("effect"),
                            F.date_trunc(bucket, "timestamp").cast("timestamp_ntz").alias("_bucket"))
    w_in = Window.partitionBy("account_id", "_bucket").orderBy("timestamp", "transaction_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = t.withColumn("_local", F.sum("effect").over(w_in))
    totals = t.groupBy("account_id", "_bucket").agg(F.sum("effect").alias("_total"))
    w_b = Window.partitionBy("account_id").orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(w_b), F.lit(0)))
    return join_null_safe(local, offsets.select("account_id", "_bucket", "_offset"),
                          ["account_id", "_bucket"]) \
        .select("account_id", "transaction_id", "timestamp", "transaction_type", "amount",
                "effect", (F.col("_local") + F.col("_offset")).cast("decimal(38,2)")
                .alias("running_balance"))
