"""DuckDB text of the fixture views (FIXTURES.md Part B) for the SQL oracle.

Each oracle query names the views it reads; ``with_views`` puts them in front
as common table expressions over the driver's pre-registered tables.
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "users": """
SELECT DISTINCT concat('u', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING)) AS user_id,
       concat('User ', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING)) AS name,
       concat('u', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING), '@example.com') AS email,
       CASE WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 20 = 0 THEN 'admin'
            WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 20 <= 3 THEN 'staff'
            WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 20 = 4 THEN 'AdMiN'
            WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 20 = 5 THEN 'invalid_role'
            ELSE 'user' END AS role_raw
FROM customer""",
    "accounts": """
SELECT concat('acc', lpad(CAST(c_custkey AS STRING), 9, '0')) AS account_id,
       concat('u', CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING)) AS user_id,
       CASE c_custkey % 3 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' ELSE 'credit' END AS account_type,
       CAST(c_acctbal AS DECIMAL(18, 2)) AS balance,
       'USD' AS currency,
       CASE WHEN c_acctbal < 0 THEN 'frozen' ELSE 'active' END AS status
FROM customer""",
    "transactions": """
SELECT concat('t', CAST(o_orderkey AS STRING)) AS transaction_id,
       concat('acc', lpad(CAST(o_custkey AS STRING), 9, '0')) AS account_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal'
                           WHEN 2 THEN 'transfer' ELSE 'payment' END AS transaction_type,
       CAST(CASE WHEN o_orderkey % 8 = 2 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2)) AS amount,
       'USD' AS currency,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('Order ', CAST(o_orderkey AS STRING)) END AS description,
       o_orderdate AS timestamp,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status
FROM orders""",
    "audit": """
SELECT event_id, ts AS timestamp,
       CASE event_type
            WHEN 'click' THEN 'user_query'
            WHEN 'view' THEN 'account_access'
            WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'escalation_resolved' ELSE 'transaction_query' END
            WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'auth_success' ELSE 'tool_call' END
            ELSE CASE event_id % 4 WHEN 0 THEN 'safety_block' WHEN 1 THEN 'auth_failure'
                                   WHEN 2 THEN 'compliance_violation' ELSE 'escalation_created' END
       END AS event_type,
       concat('u', CAST(user_id AS STRING)) AS user_id,
       CASE event_type
            WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'safety_layer1_check'
                                   WHEN 1 THEN 'safety_layer2_analysis' ELSE 'safety_decision_made' END
            WHEN 'view' THEN CASE WHEN event_id % 25 = 0 THEN 'view_balance_failed' ELSE 'account_view_balance' END
            WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'ticket_resolved' ELSE 'query_transactions' END
            WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'login' ELSE 'tool_call_get_account_balance' END
            ELSE CASE event_id % 4 WHEN 0 THEN 'safety_block' WHEN 1 THEN 'login'
                                   WHEN 2 THEN 'compliance_violation' ELSE 'fraud_report' END
       END AS action,
       NOT (event_id % 25 = 0 OR (event_type = 'error' AND event_id % 4 = 1)) AS success,
       concat('acc', lpad(CAST(user_id * 10 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS STRING), 9, '0')) AS account_id,
       CASE event_id % 3 WHEN 0 THEN 'Offensive' WHEN 1 THEN 'prompt_injection' ELSE 'pii_extraction' END AS risk_category,
       CASE event_id % 12 WHEN 0 THEN 'SAFETY-001' WHEN 1 THEN 'SAFETY-002' WHEN 2 THEN 'SAFETY-003'
            WHEN 3 THEN 'SAFETY-004' WHEN 4 THEN 'SAFETY-005' WHEN 5 THEN 'COMP-001' WHEN 6 THEN 'COMP-002'
            WHEN 7 THEN 'COMP-003' WHEN 8 THEN 'COMP-004' WHEN 9 THEN 'COMP-005' WHEN 10 THEN 'COMP-006'
            ELSE 'COMP-007' END AS violated_rule,
       CAST(value AS DECIMAL(18, 2)) AS latency_ms,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens
FROM events""",
    "escalations": """
SELECT concat('esc', CAST(event_id AS STRING)) AS id,
       concat('u', CAST(user_id AS STRING)) AS user_id,
       concat('Request ', props) AS input_text,
       CASE event_id % 3 WHEN 0 THEN 'Fraud report - requires immediate human review'
            WHEN 1 THEN 'Off-topic request' ELSE 'Low confidence' END AS agent_reasoning,
       CAST(floor(value / 5) / 100 AS DECIMAL(4, 2)) AS confidence,
       ts AS created_at,
       CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status,
       CASE WHEN event_id % 3 = 0 THEN 'u0' END AS resolved_by
FROM events WHERE event_type = 'error'""",
    "analysis": """
SELECT event_id AS request_id, concat('u', CAST(user_id AS STRING)) AS user_id,
       CAST((event_id * 37) % 101 / 100.0 AS DECIMAL(4, 2)) AS safety_score,
       CAST((event_id * 53) % 101 / 100.0 AS DECIMAL(4, 2)) AS compliance_score,
       CAST((event_id * 71) % 101 / 100.0 AS DECIMAL(4, 2)) AS confidence,
       CASE event_id % 10 WHEN 0 THEN 'COMP-001' WHEN 1 THEN 'SAFETY-003' WHEN 2 THEN 'SAFETY-005'
            WHEN 3 THEN 'COMP-004' ELSE NULL END AS violated_rule,
       event_id % 2 = 0 AS banking_intent
FROM events""",
    "transfer_requests": """
SELECT l_orderkey, l_linenumber, l_shipdate AS requested_at,
       concat('u', CAST(CASE WHEN l_suppkey % 13 = 0 THEN CAST(floor(o_custkey / 10) AS BIGINT) + 1
                             ELSE CAST(floor(o_custkey / 10) AS BIGINT) END AS STRING)) AS requester_id,
       concat('acc', lpad(CAST(o_custkey AS STRING), 9, '0')) AS from_account_id,
       concat('acc', lpad(CAST(CASE WHEN l_partkey % 11 = 0 THEN o_custkey + 10
            ELSE CAST(floor(o_custkey / 10) AS BIGINT) * 10 + l_linenumber END AS STRING), 9, '0')) AS to_account_id,
       CAST(CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE floor(l_extendedprice) / 100 END AS DECIMAL(18, 2)) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "user_requests": """
SELECT conv_id, turn, text AS input_text FROM conversations WHERE role = 'user'""",
}

# Fixed dimension rows, written as VALUES lists (same values as govlake.schemas).
ROLE_ALIAS_SQL = "(SELECT unnest(['user','staff','admin','system']) AS role)"


def with_views(sql: str, *extra: str) -> str:
    """Prefix ``sql`` with the fixture views it mentions (plus ``extra`` CTEs)."""
    text = sql + "\n".join(extra)
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", text)]
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in used] + list(extra)
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
