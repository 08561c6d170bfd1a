"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

A query reads the driver's tables through the fixture views and runs one
operator (or a short chain) over the whole tables.  Parameters that the
reference takes from the wall clock or from one interactive call (``as_of``,
lookback) are fixed here and named.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import access, iam, ledger
from ..sources import fixtures as V
from ..sources.tables import read_table

AS_OF_ORDERS = S.AS_OF_ORDERS
AS_OF_EVENTS = S.AS_OF_EVENTS
HISTORY_LOOKBACK_DAYS = 365

REGISTRY: dict = {}


def query(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


def _roles(spark, sf):
    return iam.normalise_roles(V.users(spark, sf))


# --- slice one: history ------------------------------------------------------

@query("recent_transactions")
def q_recent_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.recent_transactions(V.transactions(spark, sf), AS_OF_ORDERS,
                                      HISTORY_LOOKBACK_DAYS)


@query("governance_tables")
def q_governance_tables(spark, sf):
    """SRC-4: typed read of the transactions table (the largest of the four)."""
    return V.transactions(spark, sf)


@query("governance_users")
def q_governance_users(spark, sf):
    """SRC-4: the users table."""
    return V.users(spark, sf)


@query("governance_accounts")
def q_governance_accounts(spark, sf):
    """SRC-4: the accounts table."""
    return V.accounts(spark, sf)


@query("governance_tickets")
def q_governance_tickets(spark, sf):
    """SRC-4: the escalation tickets table."""
    return V.escalations(spark, sf)


@query("role_normalise")
def q_role_normalise(spark, sf):
    return _roles(spark, sf)


@query("txn_lookback")
def q_txn_lookback(spark, sf):
    return access.txn_lookback(V.transactions(spark, sf), AS_OF_ORDERS, HISTORY_LOOKBACK_DAYS)


@query("visible_accounts")
def q_visible_accounts(spark, sf):
    return access.visible_accounts(V.accounts(spark, sf), _roles(spark, sf))


@query("visible_transactions")
def q_visible_transactions(spark, sf):
    return access.visible_transactions(V.transactions(spark, sf), V.accounts(spark, sf),
                                       _roles(spark, sf), AS_OF_ORDERS,
                                       HISTORY_LOOKBACK_DAYS)


@query("visible_tickets")
def q_visible_tickets(spark, sf):
    return access.visible_tickets(V.escalations(spark, sf), _roles(spark, sf))


@query("tickets_by_status")
def q_tickets_by_status(spark, sf):
    return access.visible_tickets(V.escalations(spark, sf), _roles(spark, sf), status="pending")


def _transfer_access_requests(spark, sf):
    """Both account reads of every transfer request, as access requests."""
    t = V.transfer_requests(spark, sf)
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"),
                      F.col("l_linenumber").cast("string"))
    legs = F.array(F.struct(F.lit("from").alias("leg"), F.col("from_account_id").alias("a")),
                   F.struct(F.lit("to").alias("leg"), F.col("to_account_id").alias("a")))
    return t.select(key.alias("k"), F.col("requester_id").alias("caller_id"),
                    F.explode(legs).alias("x")) \
        .select(F.concat_ws("-", "k", "x.leg").alias("request_id"), "caller_id",
                F.col("x.a").alias("account_id"))


@query("account_access_outcome")
def q_account_access_outcome(spark, sf):
    return access.account_access_outcome(_transfer_access_requests(spark, sf),
                                         _roles(spark, sf), V.accounts(spark, sf))


# --- ledger ------------------------------------------------------------------

@query("user_total_balance")
def q_user_total_balance(spark, sf):
    return ledger.user_total_balance(V.accounts(spark, sf))


@query("transfer_pair_join")
def q_transfer_pair_join(spark, sf):
    return access.transfer_pair_join(V.transfer_requests(spark, sf), V.accounts(spark, sf))


@query("transfer_precheck")
def q_transfer_precheck(spark, sf):
    return ledger.transfer_precheck(V.transfer_requests(spark, sf), _roles(spark, sf),
                                    V.accounts(spark, sf)).select(
        "l_orderkey", "l_linenumber", "requester_id", "requester_role", "from_account_id",
        "to_account_id", "amount", "outcome")


@query("account_running_balance")
def q_account_running_balance(spark, sf):
    return ledger.account_running_balance(V.transactions(spark, sf))


# --- audit log ---------------------------------------------------------------

from ..operators import audit as A  # noqa: E402
from ..sources import audit_log as L  # noqa: E402
from ..sources import sinks as K  # noqa: E402
from ..session import materialize, scratch_path  # noqa: E402

AUDIT_USER = "u7"
AUDIT_ACTION = "balance"
AUDIT_EVENT = "account_access"
AUDIT_DATE = "2024-01-15"
LOG_CALLER = "u1"       # a staff member (holds view_logs)
RECENT_LIMIT = 50
TAIL_PER_USER = 5


@query("audit_filter_user")
def q_audit_filter_user(spark, sf):
    return A.filter_user(V.audit(spark, sf), AUDIT_USER)


@query("audit_filter_action")
def q_audit_filter_action(spark, sf):
    return A.filter_action(V.audit(spark, sf), AUDIT_ACTION)


@query("audit_filter_event")
def q_audit_filter_event(spark, sf):
    return A.filter_event(V.audit(spark, sf), AUDIT_EVENT)


@query("audit_filter_combined")
def q_audit_filter_combined(spark, sf):
    return A.filter_combined(V.audit(spark, sf), action=AUDIT_ACTION, event_type=AUDIT_EVENT,
                             date=AUDIT_DATE)


@query("audit_failures")
def q_audit_failures(spark, sf):
    return A.failures(V.audit(spark, sf))


@query("audit_summary")
def q_audit_summary(spark, sf):
    return A.summary(V.audit(spark, sf))


@query("audit_by_event_type")
def q_audit_by_event_type(spark, sf):
    return A.counts_by(V.audit(spark, sf), "event_type")


@query("audit_by_user")
def q_audit_by_user(spark, sf):
    return A.counts_by(V.audit(spark, sf), "user_id")


@query("audit_tail")
def q_audit_tail(spark, sf):
    return A.tail_per_user(V.audit(spark, sf), TAIL_PER_USER)


@query("recent_audit")
def q_recent_audit(spark, sf):
    return A.recent_audit(V.audit(spark, sf), _roles(spark, sf), LOG_CALLER, RECENT_LIMIT)


@query("top_users")
def q_top_users(spark, sf):
    return A.top_counts(V.audit(spark, sf), "user_id", 10)


@query("top_tools")
def q_top_tools(spark, sf):
    """Most used tools: every event whose action belongs to a tool."""
    return A.top_counts(_tool_calls(spark, sf), "tool", 10)


@query("audit_compact")
def q_audit_compact(spark, sf):
    return A.compact(V.audit(spark, sf))


@query("audit_by_date")
def q_audit_by_date(spark, sf):
    """The newest day of the log as SNK-1 wrote it; the other days stay closed."""
    ev = L.read_audit_day(spark, _audit_jsonl(spark, sf))
    return _scanned(ev)


#: Lines planted among the events of the log: every so many of each kind.
BAD_LINES = {0: "   ", 1: '{"timestamp": ', 2: "[1, 2]", 3: "not a record"}


@query("audit_line_counts")
def q_audit_line_counts(spark, sf):
    """What the scan of a log with planted bad lines keeps and drops, counted
    from the folders the one pass over it stores."""
    path = _audit_jsonl(spark, sf)
    bad = F.create_map(*[F.lit(x) for kv in BAD_LINES.items() for x in kv])
    a = V.audit(spark, sf).filter(F.col("event_id") % 20 < len(BAD_LINES))
    a.select(bad[(F.col("event_id") % 20).cast("int")].alias("value")).write.mode("append").text(path + "/bad")
    out = L.ingest_log(spark, path, scratch_path(spark, "ingested"))
    return L.ingest_counts(spark, out)


@query("field_truncation")
def q_field_truncation(spark, sf):
    return A.field_truncation(read_table(spark, sf, "conversations",
                                         ["conv_id", "turn", "text"]))


def _audit_jsonl(spark, sf) -> str:
    """Write the audit events as JSON lines by day into a fresh folder under
    the checkpoint folder; return the folder."""
    path = scratch_path(spark, "audit-jsonl")
    K.write_audit(V.audit(spark, sf), path + "/log", fmt="json")
    return path + "/log"


def _scanned(ev):
    """Typed columns of scanned audit events, detail fields extracted."""
    d = F.col("details")
    return ev.select(
        "timestamp", "event_type", "user_id", "action", "success",
        F.try_variant_get(d, "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get(d, "$.account_id", "string").alias("account_id"),
        F.try_variant_get(d, "$.latency_ms", "decimal(18,2)").alias("latency_ms"),
        F.try_variant_get(d, "$.tokens", "bigint").alias("tokens"), "event_date")


@query("audit_jsonl_scan")
def q_audit_jsonl_scan(spark, sf):
    return _scanned(L.read_audit(spark, _audit_jsonl(spark, sf)))


@query("audit_sink")
def q_audit_sink(spark, sf):
    """SNK-1 round trip: write Parquet by day, read back (all columns plus
    the partition column)."""
    path = scratch_path(spark, "audit-parquet") + "/log"
    K.write_audit(V.audit(spark, sf), path, fmt="parquet")
    return spark.read.parquet(path)


def _audit_with_details(spark, sf):
    """Audit events whose details carry the request text, the layer-2
    analysis and the decision of the request, as the reference logs them."""
    a = V.audit(spark, sf)
    d = DEC.decision_matrix(_analysis_with_role(spark, sf)).select(
        F.col("request_id").alias("event_id"),
        F.struct(F.col("safety_score").cast("double").alias("safety_score"),
                 F.col("compliance_score").cast("double").alias("compliance_score"),
                 F.col("confidence").cast("double").alias("confidence"),
                 F.col("violated_rules"), F.col("risk_factors"),
                 F.concat(F.lit("Scores for request "), F.col("request_id").cast("string"))
                 .alias("analysis")).alias("analysis"),
        F.struct("action", "reasoning").alias("decision"))
    return a.join(d, "event_id", "left").select(
        "timestamp", "event_type", "user_id", "action", "success",
        F.concat(F.lit("Request "), F.col("event_id").cast("string")).alias("input"),
        "analysis", "decision",
        F.when(~F.col("success"), F.concat(F.lit("failed: "), F.col("action"))).alias("error"))


def _logged_transfers(spark, sf):
    """Every transfer request as a logged event with its transfer fields, on
    the log's days in turn."""
    t = V.transfer_requests(spark, sf)
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return t.select(
        F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(cast(l_orderkey % 30 as int), l_linenumber)")
        .alias("timestamp"), F.lit("transaction").alias("event_type"),
        F.col("requester_id").alias("user_id"), F.lit("transfer_requested").alias("action"),
        F.lit(True).alias("success"),
        F.concat(F.lit("transfer_"), key).alias("transaction_id"), "amount",
        F.col("from_account_id").alias("from_account"), F.col("to_account_id").alias("to_account"),
        F.concat(F.lit("Transfer of $"), F.col("amount").cast("string"), F.lit(" from "), F.col("from_account_id"),
                 F.lit(" to "), F.col("to_account_id"), F.lit(", requested by "), F.col("requester_id"),
                 F.lit(", waiting for the checks of its accounts, of its amount and of the caller"))
        .alias("summary"))


@query("audit_verbose")
def q_audit_verbose(spark, sf):
    path = scratch_path(spark, "audit-verbose") + "/log"
    K.write_audit(_audit_with_details(spark, sf).unionByName(_logged_transfers(spark, sf),
                                                             allowMissingColumns=True), path, fmt="json")
    return A.verbose(L.read_audit(spark, path))


# --- IAM ---------------------------------------------------------------------

from ..operators import escalations as E  # noqa: E402
from ..operators import tables as TB  # noqa: E402


def _lit_map(d: dict):
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


@query("acl_decisions")
def q_acl_decisions(spark, sf):
    """Every audit event checked against the permission its type exercises."""
    req = V.audit(spark, sf).select(
        F.col("event_id").alias("request_id"), "user_id",
        _lit_map(S.EVENT_PERMISSION)[F.col("event_type")].alias("permission"))
    return iam.acl_decisions(req, _roles(spark, sf))


def _ticket_view_requests(spark, sf):
    """Who asks to see whose tickets: each owner their own, each resolver the
    owner's, and every user the whole list (no target)."""
    t = V.escalations(spark, sf)
    own = t.select(F.concat(F.col("id"), F.lit("-own")).alias("request_id"), "user_id",
                   F.col("user_id").alias("target_user_id"))
    res = t.filter(F.col("resolved_by").isNotNull()).select(
        F.concat(F.col("id"), F.lit("-resolver")).alias("request_id"),
        F.col("resolved_by").alias("user_id"), F.col("user_id").alias("target_user_id"))
    lst = V.users(spark, sf).select(F.concat(F.lit("list-"), F.col("user_id")).alias("request_id"),
                                    "user_id", F.lit(None).cast("string").alias("target_user_id"))
    return own.unionByName(res).unionByName(lst)


@query("escalation_view_acl")
def q_escalation_view_acl(spark, sf):
    return iam.escalation_view_acl(_ticket_view_requests(spark, sf), _roles(spark, sf))


def _tool_calls(spark, sf):
    a = V.audit(spark, sf)
    return a.select(F.col("event_id").alias("call_id"), "user_id",
                    _lit_map(S.ACTION_TOOL)[F.col("action")].alias("tool")) \
        .filter(F.col("tool").isNotNull())


@query("tool_call_entitlement")
def q_tool_call_entitlement(spark, sf):
    return iam.tool_call_entitlement(_tool_calls(spark, sf), _roles(spark, sf))


@query("tool_counts_by_role")
def q_tool_counts_by_role(spark, sf):
    return iam.tool_counts_by_role(_tool_calls(spark, sf), _roles(spark, sf))


# --- tickets -----------------------------------------------------------------

from ..functions.scan import asof_last  # noqa: E402

def _tickets(spark, sf):
    """The ticket table with every ticket column (resolution fields null)."""
    t = V.escalations(spark, sf)
    return t.select(*[c for c in t.columns],
                    F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
                    F.lit(None).cast("string").alias("resolution"),
                    F.lit(None).cast("string").alias("metadata"))


@query("fraud_tickets")
def q_fraud_tickets(spark, sf):
    rep = V.audit(spark, sf).filter(F.col("action") == "fraud_report").select(
        "event_id", "user_id", "account_id", F.lit(None).cast("string").alias("description"),
        "timestamp")
    return E.fraud_tickets(rep)


def _resolutions(spark, sf):
    ev = V.audit(spark, sf).filter(F.col("event_type") == "escalation_resolved") \
        .select("event_id", "user_id", "timestamp")
    tk = V.escalations(spark, sf).select("user_id", F.col("created_at").alias("timestamp"),
                                         F.col("id").alias("ticket_id"))
    r = asof_last(ev, tk, "user_id", "timestamp", "ticket_id")
    return r.select(F.col("event_id").alias("resolution_id"), F.col("user_id").alias("caller_id"),
                    "ticket_id", F.concat(F.lit("Resolved via audit event "),
                                          F.col("event_id").cast("string")).alias("note"),
                    F.col("timestamp").alias("resolved_at"))


@query("resolve_tickets")
def q_resolve_tickets(spark, sf):
    after, _ = E.resolve_tickets(_tickets(spark, sf), _resolutions(spark, sf), _roles(spark, sf))
    return after


@query("resolve_denials")
def q_resolve_denials(spark, sf):
    _, attempts = E.resolve_tickets(_tickets(spark, sf), _resolutions(spark, sf),
                                    _roles(spark, sf))
    return E.resolve_denials(attempts)


@query("queue_stats")
def q_queue_stats(spark, sf):
    """Queue statistics for every user, zeros for a user who sees no ticket."""
    return E.queue_stats_all(V.escalations(spark, sf), _roles(spark, sf))


@query("ticket_list")
def q_ticket_list(spark, sf):
    return E.ticket_list(access.visible_tickets(V.escalations(spark, sf), _roles(spark, sf)))


# --- table maintenance -------------------------------------------------------

RESEND_DAYS = 30


def _accepted_transfers(spark, sf):
    """The transfers LED-4 accepts when the requests are applied in order."""
    pre = ledger.transfer_precheck(V.transfer_requests(spark, sf), _roles(spark, sf),
                                   V.accounts(spark, sf))
    return ledger.transfer_apply(pre).filter(F.col("status") == "accepted")


@query("transfer_legs")
def q_transfer_legs(spark, sf):
    return ledger.transfer_legs(_accepted_transfers(spark, sf))


@query("bulk_append")
def q_bulk_append(spark, sf):
    """New transfer legs plus a re-sent batch (the last 30 days) appended to
    the transactions table."""
    tx = V.transactions(spark, sf)
    legs = ledger.transfer_legs(_accepted_transfers(spark, sf)).drop("from_account_id", "to_account_id")
    batch = legs.unionByName(access.txn_lookback(tx, AS_OF_ORDERS, RESEND_DAYS))
    return TB.bulk_append(tx, batch, "transaction_id", ["timestamp", "account_id", "amount"],
                          [("account_id", V.accounts(spark, sf), "account_id")])


def _offered_accounts(spark, sf):
    """A batch of account rows: one per supplier, and the existing ones again."""
    sup = read_table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"])
    new = sup.select(
        F.concat(F.lit("sup"), F.col("s_suppkey").cast("string")).alias("account_id"),
        V.user_id_of(F.col("s_suppkey")).alias("user_id"), F.lit("checking").alias("account_type"),
        F.col("s_acctbal").cast(S.MONEY).alias("balance"), F.lit("USD").alias("currency"),
        F.lit("active").alias("status"))
    return new.unionByName(V.accounts(spark, sf))


@query("bulk_append_accounts")
def q_bulk_append_accounts(spark, sf):
    """SNK-3 for accounts: the key is the account id, the parent the user."""
    return TB.bulk_append(V.accounts(spark, sf), _offered_accounts(spark, sf), "account_id",
                          ["user_id", "balance"], [("user_id", V.users(spark, sf), "user_id")])


@query("bulk_append_users")
def q_bulk_append_users(spark, sf):
    """SNK-3 for users: the owners of the offered accounts, once per account."""
    u = F.col("user_id")
    batch = _offered_accounts(spark, sf).select(
        "user_id", F.concat(F.lit("User "), u).alias("name"),
        F.concat(u, F.lit("@example.com")).alias("email"), F.lit("user").alias("role_raw"))
    return TB.bulk_append(V.users(spark, sf), batch, "user_id", ["email"])


@query("bulk_append_tickets")
def q_bulk_append_tickets(spark, sf):
    """SNK-3 for tickets: the fraud tickets of the log and the table's own
    tickets again; the parent is the user."""
    cols = ["id", "user_id", "input_text", "created_at", "status"]
    own = V.escalations(spark, sf).select(*cols)
    return TB.bulk_append(own, q_fraud_tickets(spark, sf).select(*cols).unionByName(own), "id",
                          ["created_at", "user_id"], [("user_id", V.users(spark, sf), "user_id")])


@query("constraint_audit")
def q_constraint_audit(spark, sf):
    return TB.constraint_audit(V.users(spark, sf), V.accounts(spark, sf),
                               V.transactions(spark, sf), V.escalations(spark, sf))


def _account_updates(spark, sf):
    """Every transaction read as a balance and status update of its account."""
    return V.transactions(spark, sf).select(
        "account_id", F.col("timestamp").alias("updated_at"),
        F.col("transaction_id").alias("update_id"), F.col("amount").alias("balance"),
        F.when(F.col("status") == "failed", "frozen").otherwise("active").alias("status"))


@query("latest_account_state")
def q_latest_account_state(spark, sf):
    return TB.latest_state(_account_updates(spark, sf), "account_id",
                           ["updated_at", "update_id"], ["balance", "status"])


@query("account_update")
def q_account_update(spark, sf):
    return TB.account_update(V.accounts(spark, sf), _account_updates(spark, sf))


def _retention_frames(spark, sf):
    return {"audit": (V.audit(spark, sf), "timestamp", AS_OF_EVENTS),
            "transaction": (V.transactions(spark, sf), "timestamp", AS_OF_ORDERS),
            "escalation": (V.escalations(spark, sf), "created_at", AS_OF_EVENTS),
            "compliance": (C.unified_event_log_one_pass(
                V.audit(spark, sf), _roles(spark, sf), S.EVENT_PERMISSION)
                .filter(F.col("source") == "compliance"), "timestamp", AS_OF_EVENTS)}


@query("retention_tiers")
def q_retention_tiers(spark, sf):
    return TB.retention_tiers(_retention_frames(spark, sf))


@query("retention_events")
def q_retention_events(spark, sf):
    return TB.retention_events(TB.retention_tiers(_retention_frames(spark, sf)))


@query("retention_move")
def q_retention_move(spark, sf):
    """SNK-6: all four data types stored by tier as of a month earlier, then
    the day folders moved to the tier they have now; rows and days read back."""
    out = None
    for data_type, (df, ts_col, as_of) in _retention_frames(spark, sf).items():
        path = scratch_path(spark, f"tiers-{data_type}")
        earlier = as_of - dt.timedelta(days=30)
        TB.write_tiers(df, ts_col, earlier, path)
        TB.move_tiers(spark, path, as_of)
        part = spark.read.parquet(path).groupBy("tier").agg(
            F.count("*").alias("record_count"), F.count_distinct("event_date").alias("n_days")) \
            .withColumn("data_type", F.lit(data_type))
        out = part if out is None else out.unionByName(part)
    return out


# --- text safety, rules, decisions -------------------------------------------

from ..operators import compliance as C  # noqa: E402
from ..operators import decisions as DEC  # noqa: E402
from ..operators import rules as R  # noqa: E402
from ..operators import textsafety as TS  # noqa: E402


def _docs(spark, sf):
    return read_table(spark, sf, "documents", ["doc_id", "text"])


def _lexicon(spark, sf):
    return TS.toxicity_lexicon(_docs(spark, sf), read_table(spark, sf, "labels"))


@query("toxicity_lexicon")
def q_toxicity_lexicon(spark, sf):
    return _lexicon(spark, sf)


@query("layer1_check")
def q_layer1_check(spark, sf):
    return TS.layer1_scores(_docs(spark, sf), ["doc_id"], "text", _lexicon(spark, sf))


@query("safety_gate")
def q_safety_gate(spark, sf):
    """Layer 1 over every user request of the conversations, then the gate."""
    l1 = TS.layer1_scores(V.user_requests(spark, sf), ["conv_id", "turn"], "input_text",
                          _lexicon(spark, sf))
    return DEC.safety_gate(l1)


@query("request_screening")
def q_request_screening(spark, sf):
    """Every user turn of the conversations through both safety layers, the
    decision and its ticket id; the speaker stands for the conversation's id."""
    req = V.user_requests(spark, sf).withColumn("user_id", V.user_id_of(F.col("conv_id")))
    d = DEC.request_screening(req, ["conv_id", "turn"], "input_text", _roles(spark, sf),
                              _lexicon(spark, sf))
    return d.withColumns({
        "violated_rules": F.array_join("violated_rules", ","),
        "risk_factors": F.array_join("risk_factors", ","),
        "ticket_id": F.when(F.col("action") == "escalate", E.ticket_id_of("conv_id", "turn"))})


@query("toxicity_model")
def q_toxicity_model(spark, sf):
    """Predictions of the fitted model on the held-out labelled documents."""
    from pyspark.ml.functions import vector_to_array
    model, _, test = TS.toxicity_model(_docs(spark, sf), read_table(spark, sf, "labels"))
    return model.transform(test).select(
        "doc_id", F.col("label").cast("int").alias("toxic"),
        F.col("prediction").cast("int").alias("predicted"),
        F.round(vector_to_array("probability")[1], 6).alias("p_toxic"))


@query("text_safety_check")
def q_text_safety_check(spark, sf):
    """SAF-3 on every document with the model of SAF-4."""
    model, _, _ = TS.toxicity_model(_docs(spark, sf), read_table(spark, sf, "labels"))
    return TS.text_safety_check(model.transform(_docs(spark, sf)))


@query("toxicity_model_fit")
def q_toxicity_model_fit(spark, sf):
    """SAF-4: the split loses no labelled document, and the fitted model meets its
    optimality conditions (the gap is the one of its intercept)."""
    model, train, test = TS.toxicity_model(_docs(spark, sf), read_table(spark, sf, "labels"))
    fit = TS.model_optimality(model, train, test)
    n = F.col("n_train") + F.col("n_test")
    return fit.select(n.alias("n_labelled"), (F.col("train_toxic") + F.col("test_toxic")).alias("n_toxic"),
                      F.abs(F.col("n_train") / n - 0.8).between(0, 0.1).alias("is_split_near"),
                      (F.abs(F.col("expected_toxic") - F.col("train_toxic")) < 0.05).alias("is_calibrated"),
                      (F.col("max_gradient") < 1e-4).alias("is_optimal"))


@query("text_safety_by_lexicon")
def q_text_safety_by_lexicon(spark, sf):
    """SAF-3 on every document with layer 1's lexicon score as probability;
    a document without any word has no score."""
    from pyspark.ml.functions import array_to_vector
    docs = _docs(spark, sf)
    scores = TS.layer1_scores(docs, ["doc_id"], "text", _lexicon(spark, sf)).select("doc_id", "toxicity")
    wordless = F.coalesce(F.size(TS.words("text")), F.lit(0)) <= 0
    p = F.when(~F.col("wordless"), array_to_vector(F.array(1 - F.col("toxicity"), F.col("toxicity"))))
    return TS.text_safety_check(docs.select("doc_id", wordless.alias("wordless")).join(scores, "doc_id")
                                .select("doc_id", p.alias("probability")))


@query("mask_account_numbers")
def q_mask_account_numbers(spark, sf):
    """Masked documents and web pages (whole texts)."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"]) \
        .select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("id"), "text")
    pages = read_table(spark, sf, "pages", ["page_id", "html"]) \
        .select(F.lit("pages").alias("source_table"), F.col("page_id").alias("id"),
                F.col("html").alias("text"))
    return TS.mask_account_numbers(docs.unionByName(pages), ["text"])


@query("sensitive_text_scan")
def q_sensitive_text_scan(spark, sf):
    return TS.sensitive_text_scan(_docs(spark, sf), ["doc_id"], "text")


@query("rule_matches")
def q_rule_matches(spark, sf):
    return R.rule_matches(_docs(spark, sf), ["doc_id"], "text")


@query("layer2_analysis")
def q_layer2_analysis(spark, sf):
    a = R.layer2_analysis(_docs(spark, sf), ["doc_id"], "text")
    return a.withColumn("violated_rules", F.array_join("violated_rules", ",")) \
        .withColumn("risk_factors", F.array_join("risk_factors", ","))


def _analysis_with_role(spark, sf):
    a = V.analysis(spark, sf)
    roles = _roles(spark, sf).select("user_id", "role")
    return a.join(roles, "user_id", "left").select(
        "request_id", "user_id", normalise_role_col("role").alias("role"), "safety_score",
        "compliance_score", "confidence", "violated_rule", "banking_intent",
        F.when(F.col("violated_rule").isNull(), F.array().cast("array<string>"))
         .otherwise(F.array("violated_rule")).alias("violated_rules"),
        F.array().cast("array<string>").alias("risk_factors"))


from ..functions.text import normalise_role as normalise_role_col  # noqa: E402


@query("decision_matrix")
def q_decision_matrix(spark, sf):
    return DEC.decision_matrix(_analysis_with_role(spark, sf)) \
        .drop("violated_rules", "risk_factors")


@query("decision_counts")
def q_decision_counts(spark, sf):
    return DEC.decision_counts(DEC.decision_matrix(_analysis_with_role(spark, sf)))


@query("rule_rewrite")
def q_rule_rewrite(spark, sf):
    return DEC.rule_rewrite(_docs(spark, sf), ["doc_id"], "text")


@query("escalate_low_confidence")
def q_escalate_low_confidence(spark, sf):
    return DEC.escalate_low_confidence(V.analysis(spark, sf))


@query("tickets_from_decisions")
def q_tickets_from_decisions(spark, sf):
    d = DEC.decision_matrix(_analysis_with_role(spark, sf))
    ts = V.audit(spark, sf).select(F.col("event_id").alias("request_id"),
                                   F.col("timestamp").alias("requested_at"))
    d = d.join(ts, "request_id").withColumn(
        "input_text", F.concat(F.lit("Request "), F.col("request_id").cast("string")))
    return E.tickets_from_decisions(d)


# --- compliance --------------------------------------------------------------

def _acl_for_records(spark, sf):
    a = V.audit(spark, sf)
    req = a.select(F.col("event_id").alias("request_id"), "user_id", "timestamp",
                   F.col("event_type").alias("resource"),
                   _lit_map(S.EVENT_PERMISSION)[F.col("event_type")].alias("permission"))
    return iam.acl_decisions(req, _roles(spark, sf))


def _records(spark, sf):
    a = V.audit(spark, sf)
    return [C.pci_data_access(a), C.pci_authentication(a),
            C.pci_privileged_action(a, _roles(spark, sf)),
            C.soc2_access_control(_acl_for_records(spark, sf)), C.soc2_data_processing(a),
            C.soc2_incidents(a)]


@query("pci_data_access")
def q_pci_data_access(spark, sf):
    return C.pci_data_access(V.audit(spark, sf))


@query("pci_authentication")
def q_pci_authentication(spark, sf):
    return C.pci_authentication(V.audit(spark, sf))


@query("pci_privileged_action")
def q_pci_privileged_action(spark, sf):
    return C.pci_privileged_action(V.audit(spark, sf), _roles(spark, sf))


@query("soc2_access_control")
def q_soc2_access_control(spark, sf):
    return C.soc2_access_control(_acl_for_records(spark, sf))


@query("soc2_data_processing")
def q_soc2_data_processing(spark, sf):
    return C.soc2_data_processing(V.audit(spark, sf))


@query("soc2_incidents")
def q_soc2_incidents(spark, sf):
    return C.soc2_incidents(V.audit(spark, sf))


@query("unlogged_access")
def q_unlogged_access(spark, sf):
    """COMP-003 against the records as SNK-2 wrote them."""
    records = L.read_compliance(spark, _compliance_jsonl(spark, sf)).select(
        "event_type", F.try_variant_get("details", "$.event_id", "bigint").alias("event_id"))
    return C.unlogged_access(V.audit(spark, sf), records)


@query("unlogged_access_gaps")
def q_unlogged_access_gaps(spark, sf):
    """COMP-003 against records that lost some: those whose event id is a
    multiple of 7 never arrived, those of 11 came under another type."""
    records = L.read_compliance(spark, _compliance_jsonl(spark, sf)).select(
        "event_type", F.try_variant_get("details", "$.event_id", "bigint").alias("event_id"))
    kind = F.when(F.col("event_id") % 11 == 0, "soc2_data_processing").otherwise(F.col("event_type"))
    return C.unlogged_access(V.audit(spark, sf), records.filter(F.col("event_id") % 7 != 0)
                             .withColumn("event_type", kind))


@query("unverified_access")
def q_unverified_access(spark, sf):
    """COMP-002 over the whole audit log."""
    return C.unverified_access(V.audit(spark, sf))


@query("unified_event_log")
def q_unified_event_log(spark, sf):
    return C.unified_event_log_one_pass(V.audit(spark, sf), _roles(spark, sf),
                                        S.EVENT_PERMISSION)


def _compliance_jsonl(spark, sf) -> str:
    path = scratch_path(spark, "compliance-jsonl") + "/log"
    frames = []
    for r in _records(spark, sf):
        detail = [c for c in r.columns if c not in ("framework", "timestamp", "event_type",
                                                    "user_id")]
        # each kind has its own detail fields: carry them as VARIANT so all
        # kinds are written by one job
        frames.append(r.select("framework", "timestamp", "event_type", "user_id",
                               F.parse_json(F.to_json(F.struct(*detail))).alias("details")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    K.write_compliance(out, path)
    return path


@query("compliance_sink")
def q_compliance_sink(spark, sf):
    """SNK-2 then SRC-2: records routed by framework and day, read back."""
    ev = L.read_compliance(spark, _compliance_jsonl(spark, sf))
    return ev.select("framework", "timestamp", "event_type", "user_id",
                     F.try_variant_get("details", "$.event_id", "bigint").alias("event_id"),
                     "event_date")


@query("compliance_jsonl_scan")
def q_compliance_jsonl_scan(spark, sf):
    """SRC-2 counts per framework and record type after the round trip."""
    ev = L.read_compliance(spark, _compliance_jsonl(spark, sf))
    return ev.groupBy("framework", "event_type").agg(F.count("*").alias("n"))


# --- metrics, security, windows ----------------------------------------------

from ..operators import metrics as M  # noqa: E402
from ..operators import security as SEC  # noqa: E402


@query("latency_percentiles")
def q_latency_percentiles(spark, sf):
    return M.latency_percentiles(V.audit(spark, sf))


def _sketches(spark, sf):
    return materialize(M.latency_sketches(V.audit(spark, sf)), "latency-sketches")


@query("latency_sketch_percentiles")
def q_latency_sketch_percentiles(spark, sf):
    """MET-1 by day, week and month from stored sketches alone."""
    return M.merged_percentiles(_sketches(spark, sf))


@query("latency_sketch_error")
def q_latency_sketch_error(spark, sf):
    """Whether each of them lies within the sketch's bound, against the events."""
    return M.sketch_rank_errors(M.merged_percentiles(_sketches(spark, sf)), V.audit(spark, sf))


@query("request_volume")
def q_request_volume(spark, sf):
    return M.request_volume(V.audit(spark, sf))


@query("daily_event_volume")
def q_daily_event_volume(spark, sf):
    return M.daily_event_volume(V.audit(spark, sf))


@query("error_breakdown")
def q_error_breakdown(spark, sf):
    return M.error_breakdown(V.audit(spark, sf))


@query("accounts_accessed_daily")
def q_accounts_accessed_daily(spark, sf):
    return M.accounts_accessed_daily(V.audit(spark, sf))


@query("accounts_accessed_daily_approx")
def q_accounts_accessed_daily_approx(spark, sf):
    return M.accounts_accessed_daily_approx(V.audit(spark, sf))


@query("cost_rollup")
def q_cost_rollup(spark, sf):
    return M.cost_rollup(V.audit(spark, sf))


@query("sessions")
def q_sessions(spark, sf):
    return M.sessions(V.audit(spark, sf))


@query("daily_report")
def q_daily_report(spark, sf):
    return M.daily_report(V.audit(spark, sf), V.escalations(spark, sf))


@query("system_health")
def q_system_health(spark, sf):
    return M.system_health(V.audit(spark, sf), V.escalations(spark, sf), AS_OF_EVENTS)


@query("latency_trace_rollup")
def q_latency_trace_rollup(spark, sf):
    return M.latency_trace_rollup(V.audit(spark, sf))


@query("weekly_trends")
def q_weekly_trends(spark, sf):
    return M.weekly_trends(V.audit(spark, sf))


@query("weekly_costs")
def q_weekly_costs(spark, sf):
    return M.weekly_costs(V.audit(spark, sf))


@query("cost_spike_days")
def q_cost_spike_days(spark, sf):
    return M.cost_spike_days(V.audit(spark, sf))


@query("volume_anomalies")
def q_volume_anomalies(spark, sf):
    return M.volume_anomalies(V.audit(spark, sf))


@query("brute_force")
def q_brute_force(spark, sf):
    return SEC.brute_force(V.audit(spark, sf))


def _retried_logins(spark, sf):
    """The log with retried logins: a failed login of event e is tried again
    e % 5 times, a quarter of an hour apart, and fails again."""
    a = V.audit(spark, sf)
    tries = F.when(F.col("event_type") == "auth_failure", F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int"))) \
        .otherwise(F.array(F.lit(0)))
    return a.withColumn("_try", F.explode(tries)) \
        .withColumn("timestamp", F.col("timestamp") + F.expr("make_dt_interval(0, 0, 15 * _try)")).drop("_try")


@query("brute_force_retries")
def q_brute_force_retries(spark, sf):
    """SEC-1 over the log with retried logins."""
    return SEC.brute_force(_retried_logins(spark, sf))


@query("exfiltration_p90")
def q_exfiltration_p90(spark, sf):
    """SEC-3 with a lower bound, the 90th percentile of the users' read volumes."""
    return SEC.exfiltration(V.audit(spark, sf), p=0.9)


@query("unusual_access")
def q_unusual_access(spark, sf):
    return SEC.unusual_access(V.audit(spark, sf))


@query("exfiltration")
def q_exfiltration(spark, sf):
    return SEC.exfiltration(V.audit(spark, sf))


@query("privilege_escalation")
def q_privilege_escalation(spark, sf):
    return SEC.privilege_escalation(q_acl_decisions(spark, sf))


@query("blocked_transfers")
def q_blocked_transfers(spark, sf):
    return SEC.blocked_transfers(ledger.transfer_precheck(
        V.transfer_requests(spark, sf), _roles(spark, sf), V.accounts(spark, sf)))


# --- transfers applied in order (LED-4) ---------------------------------------

@query("transfer_apply")
def q_transfer_apply(spark, sf):
    pre = ledger.transfer_precheck(V.transfer_requests(spark, sf), _roles(spark, sf),
                                   V.accounts(spark, sf))
    return ledger.transfer_apply(pre)


@query("final_balances")
def q_final_balances(spark, sf):
    return ledger.final_balances(q_transfer_apply(spark, sf), V.accounts(spark, sf))


# --- alerts (batch twins of the stream alerts) --------------------------------

from ..operators import alerts as AL  # noqa: E402
from ..streaming import streams as ST  # noqa: E402

#: Spans of time in which the streams over several micro-batches get their input.
ARRIVALS = 4


@query("alert_fraud_spike")
def q_alert_fraud_spike(spark, sf):
    return AL.fraud_spike_counts(V.audit(spark, sf))


@query("alert_error_rate")
def q_alert_error_rate(spark, sf):
    return AL.error_rate_levels(V.audit(spark, sf))


@query("alert_block_rate")
def q_alert_block_rate(spark, sf):
    return AL.block_rate_levels(V.audit(spark, sf))


@query("alert_latency")
def q_alert_latency(spark, sf):
    return AL.latency_levels(V.audit(spark, sf))


def _resolved_tickets(spark, sf):
    after, _ = E.resolve_tickets(_tickets(spark, sf), _resolutions(spark, sf), _roles(spark, sf))
    return after


@query("alert_backlog")
def q_alert_backlog(spark, sf):
    """Backlog from ticket creation and resolution times (resolutions of ESC-3)."""
    return AL.backlog(_resolved_tickets(spark, sf))


# --- streams (driven to completion with an availableNow trigger) -------------

def _stream_run(spark, name, df, output_mode="append", state_store=None):
    base = scratch_path(spark, name)
    return spark.read.parquet(ST.run_available_now(df, base + "/out", base + "/checkpoint",
                                                   output_mode=output_mode,
                                                   state_store=state_store))


def _stream_newest(spark, name, df, keys):
    base = scratch_path(spark, name)
    return ST.newest(spark.read.parquet(ST.run_snapshots(df, base + "/out", base + "/checkpoint")), keys)


@query("stream_follow")
def q_stream_follow(spark, sf):
    ev = ST.follow(spark, _audit_jsonl(spark, sf))
    return _scanned(_stream_run(spark, "follow", ev.withColumn("details", F.to_json("details")))
                    .withColumn("details", F.parse_json("details")))


@query("stream_rate")
def q_stream_rate(spark, sf):
    """Closed windows and, beside them, those still open."""
    return _stream_newest(spark, "rate", ST.rate(ST.follow(spark, _audit_jsonl(spark, sf))),
                          ["window_start", "window_end"])


@query("stream_rate_sliding")
def q_stream_rate_sliding(spark, sf):
    """Events of the last five minutes, every minute, open windows included."""
    return _stream_newest(spark, "rate-sliding",
                          ST.rate(ST.follow(spark, _audit_jsonl(spark, sf)), "5 minutes", "1 minute"),
                          ["window_start", "window_end"])


@query("stream_sessions")
def q_stream_sessions(spark, sf):
    return _stream_run(spark, "sessions", ST.sessions(ST.follow(spark, _audit_jsonl(spark, sf))))


@query("stream_alerts")
def q_stream_alerts(spark, sf):
    """Levels of closed windows and, beside them, of those still open."""
    return _stream_newest(spark, "alerts",
                          ST.alert_windows(ST.follow(spark, _audit_jsonl(spark, sf))), ["window_start"])


@query("stream_dedup")
def q_stream_dedup(spark, sf):
    """The audit log written twice (a replayed log): every line arrives twice
    and is kept once."""
    path = _audit_jsonl(spark, sf)
    K.write_audit(V.audit(spark, sf), path, fmt="json")
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path) \
        .withColumn("line_hash", F.sha2("value", 256))
    ev = L.parse_lines(lines).withColumn("event_time", F.col("timestamp").cast("timestamp")) \
        .withColumn("event_date", F.to_date("timestamp"))
    out = _stream_run(spark, "dedup", ST.dedup(ev).withColumn("details", F.to_json("details")))
    return _scanned(out.withColumn("details", F.parse_json("details")))


def _transfer_stream(spark, sf):
    """LED-4 as a stateful stream: the candidates of LED-3 arrive in ARRIVALS
    spans of time, one restart each; folder of the output and the checkpoint."""
    pre = ledger.transfer_precheck(V.transfer_requests(spark, sf), _roles(spark, sf),
                                   V.accounts(spark, sf)) \
        .filter(F.col("outcome").isin("ok", "insufficient_funds")) \
        .select("l_orderkey", "l_linenumber", "requested_at", "requester_id", "from_account_id",
                "to_account_id", "amount")
    pre = materialize(pre, "transfer-candidates")
    base = scratch_path(spark, "transfers")
    lo, hi = pre.agg(F.min("requested_at"), F.max("requested_at")).first()
    step = (hi - lo) / ARRIVALS if lo else None
    for n in range(ARRIVALS):
        at = F.col("requested_at")
        # a request without a time comes first, as in REQUEST_ORDER
        span = F.lit(n == 0) if step is None else (
            (at.isNull() | (at < F.lit(lo + step)) if n == 0 else at >= F.lit(lo + n * step))
            & (F.lit(True) if n in (0, ARRIVALS - 1) else at < F.lit(lo + (n + 1) * step)))
        pre.filter(span).write.mode("append").parquet(base + "/requests")
        stream = spark.readStream.schema(pre.schema).parquet(base + "/requests")
        ST.run_available_now(ST.transfers(stream, V.accounts(spark, sf)), base + "/out", base + "/checkpoint",
                             state_store=ST.ROCKSDB)
    return base


@query("stream_transfers")
def q_stream_transfers(spark, sf):
    return spark.read.parquet(_transfer_stream(spark, sf) + "/out")


@query("stream_final_balances")
def q_stream_final_balances(spark, sf):
    """Closing balances of all accounts, read back from the stream's state."""
    state = ST.balances_in_state(spark, _transfer_stream(spark, sf) + "/checkpoint")
    return V.accounts(spark, sf).select("account_id", "user_id", F.col("balance").alias("opening_balance")) \
        .join(state.select("account_id", F.col("balance").alias("closing_balance")), "account_id", "left") \
        .withColumn("closing_balance", F.when(F.col("opening_balance").isNotNull(), F.col("closing_balance")))


@query("stream_backlog")
def q_stream_backlog(spark, sf):
    """STR-8 on a stream: ticket creations (+1) and resolutions (-1, from
    ESC-3) arrive as files; the pending count is a running aggregate; the
    newest snapshot is returned."""
    t = _resolved_tickets(spark, sf)
    ev = t.select(F.col("created_at").alias("ts"), F.lit(1).alias("delta")).unionByName(
        t.filter(F.col("resolved_at").isNotNull())
        .select(F.col("resolved_at").alias("ts"), F.lit(-1).alias("delta")))
    base = scratch_path(spark, "backlog")
    ev.write.mode("overwrite").parquet(base + "/events")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "2") \
        .parquet(base + "/events")
    out = ST.run_snapshots(ST.backlog_stream(stream), base + "/out", base + "/checkpoint")
    snaps = spark.read.parquet(out)
    return snaps.filter(F.col("batch_id") == snaps.agg(F.max("batch_id")).scalar()) \
        .drop("batch_id")


@query("stream_tickets")
def q_stream_tickets(spark, sf):
    """Ticket table kept current by a stream of create and resolve events."""
    t = V.escalations(spark, sf)
    creates = t.select(F.lit("create").alias("kind"), "id", "user_id", "input_text",
                       "agent_reasoning", F.col("confidence").cast("double").alias("confidence"),
                       "created_at", F.col("created_at").alias("event_time_ntz"),
                       F.lit(None).cast("string").alias("actor"),
                       F.lit(None).cast("bigint").alias("seq"))
    _, attempts = E.resolve_tickets(_tickets(spark, sf), _resolutions(spark, sf), _roles(spark, sf))
    res = attempts.filter(F.col("outcome") == "resolved").select(
        F.lit("resolve").alias("kind"), F.col("ticket_id").alias("id"),
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("input_text"),
        F.lit(None).cast("string").alias("agent_reasoning"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.col("resolved_at").alias("event_time_ntz"), F.col("caller_id").alias("actor"),
        F.col("resolution_id").cast("bigint").alias("seq"))
    base = scratch_path(spark, "ticket-events")
    ev = creates.unionByName(res)
    ev.write.mode("overwrite").parquet(base + "/events")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "4") \
        .parquet(base + "/events")
    table = base + "/tickets"
    q = (stream.writeStream.foreachBatch(ST.merge_ticket_batch(table))
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(table).drop("resolved_seq")


# --- lookups and reconciliation ----------------------------------------------

from ..operators import users as U  # noqa: E402


@query("user_lookup")
def q_user_lookup(spark, sf):
    u = U.user_lookup(V.users(spark, sf), V.accounts(spark, sf))
    return u.select("user_id", "name", "email", F.size("account_ids").cast("bigint").alias("n_accounts"),
                    F.array_join("account_ids", ",").alias("account_ids"))


@query("user_account_pages")
def q_user_account_pages(spark, sf):
    """FLT-8 in pages of three account ids."""
    return U.user_account_pages(V.users(spark, sf), V.accounts(spark, sf), page_ids=3) \
        .withColumn("account_ids", F.array_join("account_ids", ","))


@query("high_value_transfers")
def q_high_value_transfers(spark, sf):
    t = V.transactions(spark, sf).filter(F.col("transaction_type") == "transfer")
    return ledger.high_value_transfers(t, V.accounts(spark, sf))


@query("transfer_leg_match")
def q_transfer_leg_match(spark, sf):
    return access.transfer_leg_match(ledger.transfer_legs(_accepted_transfers(spark, sf)))


@query("transfer_leg_faults")
def q_transfer_leg_faults(spark, sf):
    """ACC-7 over transfer requests booked leg by leg with faults, by the order's
    key: multiples of 5 lose the credit, of 7 book it twice, of 9 a cent short."""
    t = V.transfer_requests(spark, sf)
    stem = F.concat_ws("-", F.lit("transfer"), *[F.col(c).cast("string") for c in (
        "l_orderkey", "l_linenumber", "from_account_id", "to_account_id", "amount", "requested_at")])
    o = F.col("l_orderkey")
    credits = F.when(o % 5 == 0, 0).when(o % 7 == 0, 2).otherwise(1)
    debit = t.select(F.concat(stem, F.lit("_from")).alias("transaction_id"), (-F.col("amount")).alias("amount"))
    credit = t.withColumn("_n", credits).filter(F.col("_n") > 0).select(
        F.concat(stem, F.lit("_to")).alias("transaction_id"),
        F.when(o % 9 == 0, F.col("amount") - F.lit("0.01").cast(S.MONEY)).otherwise(F.col("amount"))
        .cast(S.MONEY).alias("amount"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_x")).drop("_x")
    return access.transfer_leg_match(debit.withColumn("amount", F.col("amount").cast(S.MONEY)).unionByName(credit))


@query("audit_ticket_match")
def q_audit_ticket_match(spark, sf):
    """Ticket events of the audit log linked to the user's newest ticket at
    the event's time (as-of), then reconciled with the ticket table."""
    ev = V.audit(spark, sf).filter(F.col("event_type").isin("escalation_created",
                                                             "escalation_resolved")) \
        .select("event_id", "user_id", "timestamp", "event_type")
    tk = V.escalations(spark, sf).select("user_id", F.col("created_at").alias("timestamp"),
                                         F.col("id").alias("ticket_id"))
    linked = asof_last(ev, tk, "user_id", "timestamp", "ticket_id")
    return access.audit_ticket_match(linked, V.escalations(spark, sf))


# --- streams over several micro-batches -----------------------------------------

from ..streaming import alert_events as AE  # noqa: E402
from ..streaming import late as LT  # noqa: E402
from ..streaming import sessions as SS  # noqa: E402

LATE_EVERY = 17


def _arrivals(spark, sf, late_every=None):
    """The audit log in ARRIVALS equal spans of time, one after the other;
    with ``late_every``, every so many events come two spans later."""
    a = V.audit(spark, sf)
    lo, hi = a.agg(F.min("timestamp"), F.max("timestamp")).first()
    if lo is None:
        return
    step = (hi - lo) / ARRIVALS + dt.timedelta(microseconds=1)
    span = F.lit(0)
    for n in range(1, ARRIVALS):
        span = F.when(F.col("timestamp") >= F.lit(lo + n * step), n).otherwise(span)
    late = F.when(F.col("event_id") % late_every == 0, 2).otherwise(0) if late_every else F.lit(0)
    a = a.withColumn("_arrival", span + late)
    for n in range(ARRIVALS + (2 if late_every else 0)):
        yield a.filter(F.col("_arrival") == n).drop("_arrival")


def _late(spark, sf):
    base = scratch_path(spark, "late")
    for part in _arrivals(spark, sf, LATE_EVERY):
        K.write_audit(part, base + "/log", fmt="json")
        events = ST.follow(spark, base + "/log").select(
            "event_time", "user_id", F.try_variant_get("details", "$.event_id", "bigint").alias("event_id"))
        LT.follow_late(events, base + "/out", base + "/checkpoint")
    return base + "/out"


@query("stream_late_rows")
def q_stream_late_rows(spark, sf):
    """The rows that came after the watermark of their micro-batch."""
    out = LT.late_rows(spark, _late(spark, sf))
    return out.select("event_id", "user_id", F.col("event_time").cast("timestamp_ntz").alias("timestamp"),
                      F.col("watermark").cast("timestamp_ntz").alias("watermark"),
                      F.col("batch").cast("bigint").alias("batch_id"))


@query("stream_late_counts")
def q_stream_late_counts(spark, sf):
    """Rows and late rows of every micro-batch."""
    out = LT.late_ledger(spark, _late(spark, sf))
    return out.withColumn("watermark", F.col("watermark").cast("timestamp_ntz"))


def _stream_arrivals(spark, sf, name, make):
    """Drive a stateful stream over the arrivals, one restart each; its output."""
    base = scratch_path(spark, name)
    for part in _arrivals(spark, sf):
        K.write_audit(part, base + "/log", fmt="json")
        ST.run_available_now(make(ST.follow(spark, base + "/log")), base + "/out", base + "/checkpoint",
                             state_store=ST.ROCKSDB)
    return spark.read.parquet(base + "/out")


@query("stream_active_sessions")
def q_stream_active_sessions(spark, sf):
    """Every session, closed or still active."""
    return SS.current_sessions(_stream_arrivals(spark, sf, "active-sessions", SS.session_changes))


@query("stream_alert_events")
def q_stream_alert_events(spark, sf):
    """Alerts raised, changed and cleared."""
    out = _stream_arrivals(spark, sf, "alert-events", AE.alert_edges)
    return out.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
