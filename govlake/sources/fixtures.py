"""The driver's tables seen as the governance tables (FIXTURES.md Part B).

These views only give rows in the schema the operators expect: users,
accounts, transactions, audit events, tickets, request analyses and transfer
requests.  No operator relies on how the ids were made; all of them work on
any data of these schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY, SCORE
from .tables import read_table


def _num(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def user_of_key(custkey: str | Column) -> Column:
    """Customer key -> owning user number (ten accounts per user)."""
    return F.floor(_num(custkey) / 10).cast("bigint")


def user_id_of(num: Column) -> Column:
    return F.concat(F.lit("u"), num.cast("string"))


def account_id_of(key: Column) -> Column:
    return F.concat(F.lit("acc"), F.lpad(key.cast("string"), 9, "0"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, name, email, role_raw (raw role text, see IAM-1)."""
    num = read_table(spark, sf_dir, "customer", ["c_custkey"]) \
        .select(user_of_key("c_custkey").alias("n")).distinct()
    m = F.col("n") % 20
    return num.select(
        user_id_of(F.col("n")).alias("user_id"),
        F.concat(F.lit("User "), F.col("n").cast("string")).alias("name"),
        F.concat(user_id_of(F.col("n")), F.lit("@example.com")).alias("email"),
        F.when(m == 0, "admin").when(m <= 3, "staff").when(m == 4, "AdMiN")
         .when(m == 5, "invalid_role").otherwise("user").alias("role_raw"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    k = F.col("c_custkey")
    return c.select(
        account_id_of(k).alias("account_id"),
        user_id_of(user_of_key(k)).alias("user_id"),
        F.when(k % 3 == 0, "checking").when(k % 3 == 1, "savings")
         .otherwise("credit").alias("account_type"),
        F.col("c_acctbal").cast(MONEY).alias("balance"),
        F.lit("USD").alias("currency"),
        F.when(F.col("c_acctbal") < 0, "frozen").otherwise("active").alias("status"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("t"), k.cast("string")).alias("transaction_id"),
        account_id_of(F.col("o_custkey")).alias("account_id"),
        F.when(k % 4 == 0, "deposit").when(k % 4 == 1, "withdrawal")
         .when(k % 4 == 2, "transfer").otherwise("payment").alias("transaction_type"),
        F.when(k % 8 == 2, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
         .cast(MONEY).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Order "), k.cast("string"))).alias("description"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
    )


def _k(props: str = "props") -> Column:
    return F.regexp_extract(F.col(props), "([0-9]+)", 1).cast("bigint")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events, flattened: the detail fields are plain columns."""
    e = read_table(spark, sf_dir, "events",
                   ["event_id", "ts", "user_id", "event_type", "value", "props"])
    i, et = F.col("event_id"), F.col("event_type")
    etype = (F.when(et == "click", "user_query")
             .when(et == "view", "account_access")
             .when(et == "purchase",
                   F.when(i % 5 == 0, "escalation_resolved").otherwise("transaction_query"))
             .when(et == "signup", F.when(i % 2 == 0, "auth_success").otherwise("tool_call"))
             .otherwise(F.when(i % 4 == 0, "safety_block").when(i % 4 == 1, "auth_failure")
                        .when(i % 4 == 2, "compliance_violation")
                        .otherwise("escalation_created")))
    action = (F.when(et == "click",
                     F.when(i % 3 == 0, "safety_layer1_check")
                      .when(i % 3 == 1, "safety_layer2_analysis")
                      .otherwise("safety_decision_made"))
              .when(et == "view",
                    F.when(i % 25 == 0, "view_balance_failed").otherwise("account_view_balance"))
              .when(et == "purchase",
                    F.when(i % 5 == 0, "ticket_resolved").otherwise("query_transactions"))
              .when(et == "signup",
                    F.when(i % 2 == 0, "login").otherwise("tool_call_get_account_balance"))
              .otherwise(F.when(i % 4 == 0, "safety_block").when(i % 4 == 1, "login")
                         .when(i % 4 == 2, "compliance_violation").otherwise("fraud_report")))
    rules = ["SAFETY-001", "SAFETY-002", "SAFETY-003", "SAFETY-004", "SAFETY-005",
             "COMP-001", "COMP-002", "COMP-003", "COMP-004", "COMP-005", "COMP-006",
             "COMP-007"]
    rule = F.element_at(F.array(*[F.lit(r) for r in rules]), (i % 12 + 1).cast("int"))
    return e.select(
        i.alias("event_id"),
        F.col("ts").alias("timestamp"),
        etype.alias("event_type"),
        user_id_of(F.col("user_id")).alias("user_id"),
        action.alias("action"),
        (~((i % 25 == 0) | ((et == "error") & (i % 4 == 1)))).alias("success"),
        account_id_of(F.col("user_id") * 10 + _k() % 10).alias("account_id"),
        F.when(i % 3 == 0, "Offensive").when(i % 3 == 1, "prompt_injection")
         .otherwise("pii_extraction").alias("risk_category"),
        rule.alias("violated_rule"),
        F.col("value").cast(MONEY).alias("latency_ms"),
        _k().alias("tokens"),
    )


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events",
                   ["event_id", "ts", "user_id", "event_type", "value", "props"]) \
        .filter(F.col("event_type") == "error")
    i = F.col("event_id")
    resolved = i % 3 == 0
    return e.select(
        F.concat(F.lit("esc"), i.cast("string")).alias("id"),
        user_id_of(F.col("user_id")).alias("user_id"),
        F.concat(F.lit("Request "), F.col("props")).alias("input_text"),
        F.when(i % 3 == 0, "Fraud report - requires immediate human review")
         .when(i % 3 == 1, "Off-topic request").otherwise("Low confidence")
         .alias("agent_reasoning"),
        (F.floor(F.col("value") / 5).cast("decimal(20,0)") / 100).cast(SCORE).alias("confidence"),
        F.col("ts").alias("created_at"),
        F.when(resolved, "resolved").otherwise("pending").alias("status"),
        F.when(resolved, F.lit("u0")).alias("resolved_by"),
    )


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer-2 analysis per request."""
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id"])
    i = F.col("event_id")

    def score(mult: int) -> Column:
        return ((i * mult) % 101).cast("decimal(20,0)") / 100

    return e.select(
        i.alias("request_id"),
        user_id_of(F.col("user_id")).alias("user_id"),
        score(37).cast(SCORE).alias("safety_score"),
        score(53).cast(SCORE).alias("compliance_score"),
        score(71).cast(SCORE).alias("confidence"),
        F.when(i % 10 == 0, "COMP-001").when(i % 10 == 1, "SAFETY-003")
         .when(i % 10 == 2, "SAFETY-005").when(i % 10 == 3, "COMP-004")
         .alias("violated_rule"),
        (i % 2 == 0).alias("banking_intent"),
    )


def transfer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey",
                     "l_extendedprice"])
    # what a line says about its request, before the join: flags and cents are narrow in a shuffle
    li = li.select(
        "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_suppkey") % 13 == 0).alias("by_other"),
        (F.col("l_partkey") % 11 == 0).alias("to_other"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(0))
         .otherwise(F.floor(F.col("l_extendedprice")).cast("decimal(20,0)") / 100)
         .cast(MONEY).alias("amount"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    owner = user_of_key("o_custkey")
    return j.select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("requested_at"),
        user_id_of(F.when(F.col("by_other"), owner + 1).otherwise(owner)).alias("requester_id"),
        account_id_of(F.col("o_custkey")).alias("from_account_id"),
        account_id_of(F.when(F.col("to_other"), F.col("o_custkey") + 10)
                      .otherwise(owner * 10 + F.col("l_linenumber"))).alias("to_account_id"),
        "amount",
    )


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to screen: the user turns of the conversations."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("input_text"))


VIEWS = {
    "users": users, "accounts": accounts, "transactions": transactions, "audit": audit,
    "escalations": escalations, "analysis": analysis,
    "transfer_requests": transfer_requests,
}
