"""DuckDB oracle text for every registered query that SQL can express.

Written independently of the Spark code, in plain SQL over the fixture views
(see ``oracle_views.py``).  Column names equal the Spark output's.
"""

from __future__ import annotations

from oracle_views import with_views

AS_OF_ORDERS = "TIMESTAMP '2001-08-01 00:00:00'"
AS_OF_EVENTS = "TIMESTAMP '2024-01-31 00:00:00'"

ROLES = """roles AS (SELECT user_id, role_raw,
    CASE WHEN lower(role_raw) IN ('user', 'staff', 'admin', 'system') THEN lower(role_raw)
         ELSE 'user' END AS role FROM users)"""
OWN_CTE = "own AS (SELECT user_id AS own_caller FROM roles WHERE role = 'user')"

SQL: dict[str, str] = {}

SQL["recent_transactions"] = f"""
SELECT account_id, rank, transaction_id, timestamp, type_label, amount, description,
       greatest(n - 10, 0) AS remaining
FROM (SELECT *, upper(transaction_type) AS type_label,
             row_number() OVER (PARTITION BY account_id
                                ORDER BY timestamp DESC, transaction_id DESC) AS rank,
             count(*) OVER (PARTITION BY account_id) AS n
      FROM transactions WHERE timestamp >= {AS_OF_ORDERS} - INTERVAL 365 DAY) t
WHERE rank <= 10"""

SQL["governance_users"] = "SELECT * FROM users"
SQL["governance_accounts"] = "SELECT * FROM accounts"
SQL["governance_tickets"] = "SELECT * FROM escalations"
SQL["governance_tables"] = "SELECT * FROM transactions"

SQL["role_normalise"] = "SELECT user_id, role_raw, role FROM roles"

SQL["txn_lookback"] = f"""
SELECT * FROM transactions WHERE timestamp >= {AS_OF_ORDERS} - INTERVAL 365 DAY"""

SQL["visible_accounts"] = """
SELECT a.*, o.own_caller, 'staff,admin,system' AS seen_by_roles
FROM accounts a LEFT JOIN own o ON o.own_caller = a.user_id"""

SQL["visible_transactions"] = f"""
SELECT t.*, a.user_id AS owner_id, o.own_caller, 'staff,admin,system' AS seen_by_roles
FROM transactions t JOIN accounts a ON t.account_id = a.account_id
LEFT JOIN own o ON o.own_caller = a.user_id
WHERE t.timestamp >= {AS_OF_ORDERS} - INTERVAL 365 DAY"""

SQL["visible_tickets"] = """
SELECT e.*, o.own_caller, 'staff,admin,system' AS seen_by_roles
FROM escalations e LEFT JOIN own o ON o.own_caller = e.user_id"""

SQL["tickets_by_status"] = SQL["visible_tickets"] + " WHERE e.status = 'pending'"

TRANSFER_ACCESS = """reqs AS (
  SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-from') AS request_id,
         requester_id AS caller_id, from_account_id AS account_id FROM transfer_requests
  UNION ALL
  SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-to'),
         requester_id, to_account_id FROM transfer_requests)"""

SQL["account_access_outcome"] = """
SELECT request_id, caller_id, account_id, caller_role, outcome,
       CASE WHEN outcome = 'ok' THEN owner_id END AS owner_id,
       CASE WHEN outcome = 'ok' THEN account_type END AS account_type,
       CASE WHEN outcome = 'ok' THEN balance END AS balance,
       CASE WHEN outcome = 'ok' THEN account_status END AS account_status
FROM (SELECT r.request_id, r.caller_id, r.account_id, COALESCE(ro.role, 'user') AS caller_role,
             CASE WHEN a.account_id IS NULL THEN 'not_found'
                  WHEN COALESCE(ro.role, 'user') = 'user' AND a.user_id <> r.caller_id THEN 'denied_owner'
                  ELSE 'ok' END AS outcome,
             a.user_id AS owner_id, a.account_type, a.balance, a.status AS account_status
      FROM reqs r LEFT JOIN roles ro ON ro.user_id = r.caller_id
      LEFT JOIN accounts a ON a.account_id = r.account_id) x"""

SQL["user_total_balance"] = """
SELECT user_id, count(*) AS n_accounts, sum(balance) AS total_balance
FROM accounts GROUP BY user_id"""

SQL["transfer_pair_join"] = """
SELECT t.*, s.user_id AS src_owner, s.balance AS src_balance,
       d.user_id AS dst_owner, d.balance AS dst_balance
FROM transfer_requests t LEFT JOIN accounts s ON s.account_id = t.from_account_id
LEFT JOIN accounts d ON d.account_id = t.to_account_id"""

SQL["transfer_precheck"] = """
SELECT t.l_orderkey, t.l_linenumber, t.requester_id, COALESCE(ro.role, 'user') AS requester_role,
       t.from_account_id, t.to_account_id, t.amount,
       CASE WHEN t.amount IS NULL OR t.amount <= 0 THEN 'invalid_amount'
            WHEN COALESCE(ro.role, 'user') = 'user' AND s.user_id IS NOT NULL
                 AND s.user_id <> t.requester_id THEN 'access_denied_source'
            WHEN COALESCE(ro.role, 'user') = 'user' AND d.user_id IS NOT NULL
                 AND d.user_id <> t.requester_id THEN 'access_denied_target'
            WHEN s.user_id IS NULL THEN 'source_not_found'
            WHEN d.user_id IS NULL THEN 'target_not_found'
            WHEN s.user_id <> t.requester_id THEN 'not_own_source'
            WHEN d.user_id <> t.requester_id THEN 'not_own_target'
            WHEN t.from_account_id = t.to_account_id THEN 'same_account'
            WHEN s.balance < t.amount THEN 'insufficient_funds'
            ELSE 'ok' END AS outcome
FROM transfer_requests t LEFT JOIN roles ro ON ro.user_id = t.requester_id
LEFT JOIN accounts s ON s.account_id = t.from_account_id
LEFT JOIN accounts d ON d.account_id = t.to_account_id"""

SQL["account_running_balance"] = """
SELECT account_id, transaction_id, timestamp, transaction_type, amount,
       CASE WHEN transaction_type IN ('withdrawal', 'payment') THEN -amount ELSE amount END AS effect,
       sum(CASE WHEN transaction_type IN ('withdrawal', 'payment') THEN -amount ELSE amount END)
         OVER (PARTITION BY account_id ORDER BY timestamp, transaction_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_balance
FROM transactions"""

# CTEs each query needs besides the fixture views.
EXTRA = {
    "role_normalise": [ROLES],
    "visible_accounts": [ROLES, OWN_CTE],
    "visible_transactions": [ROLES, OWN_CTE],
    "visible_tickets": [ROLES, OWN_CTE],
    "tickets_by_status": [ROLES, OWN_CTE],
    "account_access_outcome": [ROLES, TRANSFER_ACCESS],
    "transfer_precheck": [ROLES],
}



# --- audit log ---------------------------------------------------------------

SQL["audit_filter_user"] = "SELECT * FROM audit WHERE user_id = 'u7'"
SQL["audit_filter_action"] = "SELECT * FROM audit WHERE contains(COALESCE(action, ''), 'balance')"
SQL["audit_filter_event"] = "SELECT * FROM audit WHERE event_type = 'account_access'"
SQL["audit_filter_combined"] = """
SELECT * FROM audit WHERE CAST(timestamp AS DATE) = DATE '2024-01-15'
  AND contains(COALESCE(action, ''), 'balance') AND event_type = 'account_access'"""
SQL["audit_failures"] = """
SELECT * FROM audit WHERE NOT COALESCE(success, true)
   OR contains(COALESCE(action, ''), 'failed') OR contains(COALESCE(action, ''), 'error')"""
SQL["audit_summary"] = """
SELECT count(*) AS total, count(*) FILTER (WHERE COALESCE(success, true)) AS success,
       count(*) FILTER (WHERE NOT COALESCE(success, true)) AS failure FROM audit"""
SQL["audit_by_event_type"] = """
SELECT COALESCE(event_type, 'unknown') AS event_type, count(*) AS n FROM audit GROUP BY 1"""
SQL["audit_by_user"] = """
SELECT COALESCE(user_id, 'unknown') AS user_id, count(*) AS n FROM audit GROUP BY 1"""
SQL["audit_tail"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                 ORDER BY timestamp DESC, event_id DESC) AS pos FROM audit) WHERE pos <= 5"""
SQL["recent_audit"] = """
SELECT * FROM audit
WHERE EXISTS (SELECT 1 FROM roles WHERE user_id = 'u1' AND role IN ('staff', 'admin', 'system'))
ORDER BY timestamp DESC, event_id DESC LIMIT 50"""
SQL["top_users"] = """
SELECT user_id, count(*) AS n FROM audit GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"""
SQL["audit_compact"] = """
SELECT event_id, strftime(timestamp, '%H:%M:%S') AS time,
       CASE WHEN COALESCE(success, true) THEN '✓' ELSE '✗' END AS mark,
       COALESCE(event_type, 'unknown') AS event_type, COALESCE(user_id, 'unknown') AS user_id,
       COALESCE(action, 'unknown') AS action FROM audit"""
SQL["audit_by_date"] = """
SELECT timestamp, event_type, user_id, action, success, event_id, account_id, latency_ms, tokens,
       CAST(timestamp AS DATE) AS event_date
FROM audit WHERE CAST(timestamp AS DATE) = (SELECT max(CAST(timestamp AS DATE)) FROM audit)"""
SQL["audit_line_counts"] = """
SELECT count(*) + count(*) FILTER (WHERE event_id % 20 < 4) AS n_lines, count(*) AS n_kept,
       count(*) FILTER (WHERE event_id % 20 = 0) AS n_blank,
       count(*) FILTER (WHERE event_id % 20 IN (1, 3)) AS n_not_json,
       count(*) FILTER (WHERE event_id % 20 = 2) AS n_not_object
FROM audit"""
SQL["field_truncation"] = """
SELECT conv_id, turn, left(text, 200) AS query, left(text, 100) AS blocked_text,
       left(text, 200) AS fraud_text, left(text, 200) AS summary,
       left(text, 2000) AS full_response, left(text, 200) AS layer_input,
       left(text, 500) AS callback_input, left(text, 200) AS resolution_note
FROM conversations"""
EXTRA["recent_audit"] = [ROLES]



# --- IAM ---------------------------------------------------------------------

# The reference's role -> permission sets and tool -> permission sets.
ROLE_PERM = """role_perm(role, permission) AS (VALUES
  ('user', 'use_agent'), ('user', 'view_own_escalations'), ('user', 'view_accounts'),
  ('user', 'view_transactions'),
  ('staff', 'use_agent'), ('staff', 'view_own_escalations'), ('staff', 'view_all_escalations'),
  ('staff', 'resolve_escalations'), ('staff', 'view_accounts'), ('staff', 'view_transactions'),
  ('staff', 'view_config'), ('staff', 'view_logs'),
  ('admin', 'use_agent'), ('admin', 'view_own_escalations'), ('admin', 'view_all_escalations'),
  ('admin', 'resolve_escalations'), ('admin', 'view_accounts'), ('admin', 'view_transactions'),
  ('admin', 'view_config'), ('admin', 'modify_config'), ('admin', 'modify_compliance_rules'),
  ('admin', 'view_logs'), ('admin', 'manage_users'),
  ('system', 'view_own_escalations'), ('system', 'view_all_escalations'),
  ('system', 'resolve_escalations'), ('system', 'use_agent'), ('system', 'bypass_safety_checks'),
  ('system', 'view_accounts'), ('system', 'view_transactions'), ('system', 'view_config'),
  ('system', 'modify_config'), ('system', 'modify_compliance_rules'), ('system', 'view_logs'),
  ('system', 'manage_users'))"""
TOOL_PERM = """tool_perm(tool, permission) AS (VALUES
  ('account_balance', 'view_accounts'), ('transaction_history', 'view_transactions'),
  ('list_accounts', 'view_accounts'), ('report_fraud', 'use_agent'),
  ('transfer_money', 'use_agent'), ('safety_layer1', 'use_agent'),
  ('safety_layer2', 'use_agent'), ('safety_decision', 'use_agent'),
  ('create_escalation', 'use_agent'), ('log_response', 'use_agent'),
  ('list_escalations', 'view_own_escalations'), ('list_escalations', 'view_all_escalations'),
  ('view_audit_logs', 'view_logs'), ('resolve_escalation', 'resolve_escalations'))"""
EVENT_PERM = """event_perm(event_type, permission) AS (VALUES
  ('user_query', 'use_agent'), ('account_access', 'view_accounts'),
  ('transaction_query', 'view_transactions'), ('tool_call', 'use_agent'),
  ('safety_block', 'use_agent'), ('compliance_violation', 'use_agent'),
  ('escalation_created', 'use_agent'), ('escalation_resolved', 'resolve_escalations'),
  ('auth_success', 'use_agent'), ('auth_failure', 'use_agent'))"""
ACTION_TOOL = """CASE action WHEN 'safety_layer1_check' THEN 'safety_layer1'
  WHEN 'safety_layer2_analysis' THEN 'safety_layer2' WHEN 'safety_decision_made' THEN 'safety_decision'
  WHEN 'account_view_balance' THEN 'account_balance' WHEN 'view_balance_failed' THEN 'account_balance'
  WHEN 'query_transactions' THEN 'transaction_history' WHEN 'ticket_resolved' THEN 'resolve_escalation'
  WHEN 'tool_call_get_account_balance' THEN 'account_balance' WHEN 'fraud_report' THEN 'report_fraud'
  END"""

SQL["acl_decisions"] = """
SELECT a.event_id AS request_id, a.user_id, COALESCE(r.role, 'user') AS role, p.permission,
       rp.role IS NOT NULL AS granted,
       CASE WHEN rp.role IS NOT NULL THEN 'granted'
            ELSE concat('User ', a.user_id, ' (role: ', COALESCE(r.role, 'user'),
                        ') does not have permission: ', p.permission) END AS reason
FROM audit a JOIN event_perm p ON p.event_type = a.event_type
LEFT JOIN roles r ON r.user_id = a.user_id
LEFT JOIN role_perm rp ON rp.role = COALESCE(r.role, 'user') AND rp.permission = p.permission"""
EXTRA["acl_decisions"] = [ROLES, ROLE_PERM, EVENT_PERM]

SQL["escalation_view_acl"] = """
SELECT q.request_id, q.user_id, COALESCE(r.role, 'user') AS role, q.target_user_id,
       COALESCE(CASE WHEN q.target_user_id IS NOT NULL AND q.target_user_id = q.user_id THEN f.vo
                     WHEN q.target_user_id IS NOT NULL THEN f.va
                     ELSE f.vo OR f.va END, false) AS allowed
FROM reqs q LEFT JOIN roles r ON r.user_id = q.user_id
LEFT JOIN flags f ON f.role = COALESCE(r.role, 'user')"""
EXTRA["escalation_view_acl"] = [ROLES, ROLE_PERM, """reqs AS (
  SELECT concat(id, '-own') AS request_id, user_id, user_id AS target_user_id FROM escalations
  UNION ALL SELECT concat(id, '-resolver'), resolved_by, user_id FROM escalations
            WHERE resolved_by IS NOT NULL
  UNION ALL SELECT concat('list-', user_id), user_id, NULL FROM users)""",
    """flags AS (SELECT role, bool_or(permission = 'view_own_escalations') AS vo,
                        bool_or(permission = 'view_all_escalations') AS va
                 FROM role_perm GROUP BY role)"""]

SQL["tool_call_entitlement"] = """
SELECT c.call_id, c.user_id, COALESCE(r.role, 'user') AS role, c.tool,
       rt.tool IS NOT NULL AS entitled
FROM calls c LEFT JOIN roles r ON r.user_id = c.user_id
LEFT JOIN role_tool rt ON rt.role = COALESCE(r.role, 'user') AND rt.tool = c.tool
WHERE c.tool IS NOT NULL"""
EXTRA["tool_call_entitlement"] = [ROLES, ROLE_PERM, TOOL_PERM,
    f"calls AS (SELECT event_id AS call_id, user_id, {ACTION_TOOL} AS tool FROM audit)",
    """role_tool AS (SELECT DISTINCT rp.role, tp.tool FROM role_perm rp
                     JOIN tool_perm tp ON rp.permission = tp.permission)"""]

# --- tickets -----------------------------------------------------------------


def uuid_of(expr: str) -> str:
    h = f"sha256({expr})"
    return (f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), "
            f"substr({h}, 17, 4), substr({h}, 21, 12))")


SQL["fraud_tickets"] = f"""
SELECT {uuid_of('CAST(event_id AS VARCHAR)')} AS id, user_id,
       concat('Fraud report for account ', account_id, ': ', '') AS input_text,
       'Fraud report - requires immediate human review' AS agent_reasoning,
       CAST(1.0 AS DOUBLE) AS confidence, timestamp AS created_at, 'pending' AS status,
       CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS VARCHAR) AS resolved_by,
       CAST(NULL AS VARCHAR) AS resolution,
       concat('{{"account_id":"', account_id, '","type":"fraud_report"}}') AS metadata
FROM audit WHERE action = 'fraud_report'"""

RESOLUTION_CTES = [ROLES, """tickets AS (SELECT *, CAST(NULL AS TIMESTAMP) AS resolved_at,
        CAST(NULL AS VARCHAR) AS resolution, CAST(NULL AS VARCHAR) AS metadata FROM escalations)""",
    """u AS (SELECT user_id, timestamp, 1 AS side, CAST(NULL AS VARCHAR) AS ticket_id, event_id
         FROM audit WHERE event_type = 'escalation_resolved'
         UNION ALL SELECT user_id, created_at, 0, id, NULL FROM escalations)""",
    """asof_t AS (SELECT event_id, user_id, timestamp, side,
         last_value(ticket_id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, side, ticket_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ticket_id FROM u)""",
    """res AS (SELECT event_id AS resolution_id, user_id AS caller_id, ticket_id,
         concat('Resolved via audit event ', CAST(event_id AS VARCHAR)) AS note,
         timestamp AS resolved_at FROM asof_t WHERE side = 1)""",
    """att AS (SELECT res.*, COALESCE(r.role, 'user') AS caller_role,
         CASE WHEN COALESCE(r.role, 'user') NOT IN ('staff', 'admin', 'system') THEN 'denied'
              WHEN t.id IS NULL THEN 'unknown_ticket' ELSE 'resolved' END AS outcome
         FROM res LEFT JOIN roles r ON r.user_id = res.caller_id
         LEFT JOIN escalations t ON t.id = res.ticket_id)""",
    """lastres AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id
           ORDER BY resolved_at DESC, resolution_id DESC) AS rn FROM att WHERE outcome = 'resolved')
         WHERE rn = 1)"""]

SQL["resolve_tickets"] = """
SELECT t.id, t.user_id, t.input_text, t.agent_reasoning, t.confidence, t.created_at,
       CASE WHEN l.ticket_id IS NOT NULL THEN 'resolved' ELSE t.status END AS status,
       CASE WHEN l.ticket_id IS NOT NULL THEN l.caller_id ELSE t.resolved_by END AS resolved_by,
       CASE WHEN l.ticket_id IS NOT NULL THEN l.resolved_at ELSE t.resolved_at END AS resolved_at,
       CASE WHEN l.ticket_id IS NOT NULL THEN left(l.note, 200) ELSE t.resolution END AS resolution,
       t.metadata
FROM tickets t LEFT JOIN lastres l ON l.ticket_id = t.id"""
EXTRA["resolve_tickets"] = RESOLUTION_CTES

SQL["resolve_denials"] = """
SELECT resolved_at AS timestamp, 'safety_block' AS event_type, caller_id AS user_id,
       'resolve_ticket_unauthorized' AS action, false AS success, ticket_id, caller_role AS role
FROM att WHERE outcome = 'denied'"""
EXTRA["resolve_denials"] = RESOLUTION_CTES

SQL["queue_stats"] = """
SELECT c.user_id AS caller_id, count(e.id) AS total, count(e.id) FILTER (WHERE e.status = 'pending') AS pending,
       count(e.id) FILTER (WHERE e.status = 'resolved') AS resolved,
       round(COALESCE(avg(CAST(e.confidence AS DOUBLE)), 0.0), 6) AS avg_confidence
FROM roles c LEFT JOIN escalations e ON c.role <> 'user' OR e.user_id = c.user_id
GROUP BY c.user_id"""
EXTRA["queue_stats"] = [ROLES]

SQL["ticket_list"] = """
SELECT e.caller_id,
       row_number() OVER (PARTITION BY e.caller_id ORDER BY e.created_at DESC, e.id DESC) AS n,
       e.id, e.user_id, strftime(e.created_at, '%Y-%m-%d %H:%M') AS created,
       upper(e.status) AS status_label, e.input_text,
       CASE WHEN length(e.agent_reasoning) > 200 THEN concat(left(e.agent_reasoning, 200), '...')
            ELSE e.agent_reasoning END AS reasoning,
       CASE WHEN e.status = 'resolved' THEN e.resolved_by END AS resolved_by,
       CAST(NULL AS VARCHAR) AS resolution_note,
       CASE WHEN e.status <> 'resolved' THEN e.confidence END AS confidence
FROM (SELECT NULL AS caller_id, * FROM escalations
      UNION ALL SELECT own_caller, e.* FROM escalations e JOIN own ON own_caller = e.user_id) e"""
EXTRA["ticket_list"] = [ROLES, OWN_CTE]

# --- table maintenance -------------------------------------------------------

PRECHECK_CTE = "pre AS (" + SQL["transfer_precheck"].strip() + ")"
# The requests in order per requester, applied one after the other: the map
# holds the balances of the requester's accounts touched so far.
OUTCOME = SQL["transfer_precheck"][SQL["transfer_precheck"].index("CASE WHEN t.amount"):
                                   SQL["transfer_precheck"].index("AS outcome")]
FOLD_CTES = [f"""fold_in AS (
  SELECT t.*, s.balance AS sb, d.balance AS db, {OUTCOME} AS outcome
  FROM transfer_requests t LEFT JOIN roles ro ON ro.user_id = t.requester_id
  LEFT JOIN accounts s ON s.account_id = t.from_account_id
  LEFT JOIN accounts d ON d.account_id = t.to_account_id)""",
    """fold_num AS (
  SELECT *, row_number() OVER (PARTITION BY requester_id ORDER BY requested_at, l_orderkey,
                               l_linenumber, from_account_id, to_account_id, amount) AS n
  FROM fold_in WHERE outcome IN ('ok', 'insufficient_funds'))""",
    """fold AS (
  SELECT n, requester_id, l_orderkey, l_linenumber, requested_at, from_account_id, to_account_id, amount,
         sb >= amount AS accepted,
         CAST(CASE WHEN sb >= amount THEN sb - amount ELSE sb END AS DECIMAL(18, 2)) AS sa,
         CAST(CASE WHEN sb >= amount THEN db + amount ELSE db END AS DECIMAL(18, 2)) AS da,
         MAP {from_account_id: CAST(CASE WHEN sb >= amount THEN sb - amount ELSE sb END AS DECIMAL(18, 2)),
              to_account_id: CAST(CASE WHEN sb >= amount THEN db + amount ELSE db END AS DECIMAL(18, 2))} AS bal
  FROM fold_num WHERE n = 1
  UNION ALL
  SELECT n, requester_id, l_orderkey, l_linenumber, requested_at, from_account_id, to_account_id, amount,
         accepted, sa, da, map_concat(bal, MAP {from_account_id: sa, to_account_id: da})
  FROM (SELECT *, s >= amount AS accepted,
               CAST(CASE WHEN s >= amount THEN s - amount ELSE s END AS DECIMAL(18, 2)) AS sa,
               CAST(CASE WHEN s >= amount THEN d + amount ELSE d END AS DECIMAL(18, 2)) AS da
        FROM (SELECT x.*, f.bal, COALESCE(f.bal[x.from_account_id], x.sb) AS s,
                     COALESCE(f.bal[x.to_account_id], x.db) AS d
              FROM fold f JOIN fold_num x ON x.requester_id = f.requester_id AND x.n = f.n + 1) y) z)"""]
SQL["transfer_apply"] = """
SELECT l_orderkey, l_linenumber, requested_at, requester_id, from_account_id, to_account_id, amount,
       CASE WHEN accepted THEN 'accepted' ELSE 'insufficient_funds' END AS status,
       sa AS src_balance_after, da AS dst_balance_after FROM fold
UNION ALL
SELECT l_orderkey, l_linenumber, requested_at, requester_id, from_account_id, to_account_id, amount,
       outcome, NULL, NULL FROM fold_in WHERE outcome NOT IN ('ok', 'insufficient_funds')"""
EXTRA["transfer_apply"] = [ROLES, *FOLD_CTES]
SQL["final_balances"] = """
SELECT a.account_id, a.user_id, a.balance AS opening_balance,
       CAST(a.balance + COALESCE(m.delta, 0) AS DECIMAL(18, 2)) AS closing_balance
FROM accounts a LEFT JOIN (
  SELECT account_id, sum(d) AS delta FROM (
    SELECT from_account_id AS account_id, -amount AS d FROM fold WHERE accepted
    UNION ALL SELECT to_account_id, amount FROM fold WHERE accepted) e GROUP BY account_id) m
  ON m.account_id = a.account_id"""
EXTRA["final_balances"] = [ROLES, *FOLD_CTES]
SQL["stream_transfers"] = """
SELECT l_orderkey, l_linenumber, requester_id, from_account_id, to_account_id, amount,
       CASE WHEN accepted THEN 'accepted' ELSE 'insufficient_funds' END AS status,
       sa AS src_balance_after, da AS dst_balance_after FROM fold"""
EXTRA["stream_transfers"] = [ROLES, *FOLD_CTES]
SQL["stream_final_balances"] = SQL["final_balances"]
EXTRA["stream_final_balances"] = EXTRA["final_balances"]

TID = ("substr(sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
       "CAST(requested_at AS VARCHAR), from_account_id, to_account_id, CAST(amount AS VARCHAR))), 1, 32)")
LEGS_CTE = f"""legs AS (
  SELECT {TID} || '_from' AS transaction_id, from_account_id AS account_id,
         'transfer' AS transaction_type, CAST(-amount AS DECIMAL(18, 2)) AS amount, 'USD' AS currency,
         concat('Transfer to ', to_account_id, ': Transfer from ', from_account_id, ' to ', to_account_id)
           AS description, requested_at AS timestamp, 'completed' AS status,
         from_account_id, to_account_id
  FROM fold WHERE accepted
  UNION ALL
  SELECT {TID} || '_to', to_account_id, 'transfer', CAST(amount AS DECIMAL(18, 2)), 'USD',
         concat('Transfer from ', from_account_id, ': Transfer from ', from_account_id, ' to ', to_account_id),
         requested_at, 'completed', from_account_id, to_account_id
  FROM fold WHERE accepted)"""

SQL["transfer_legs"] = "SELECT * FROM legs"
EXTRA["transfer_legs"] = [ROLES, *FOLD_CTES, LEGS_CTE]

SQL["bulk_append"] = f"""
SELECT b.transaction_id, b.account_id, b.transaction_type, b.amount, b.currency, b.description,
       b.timestamp, b.status,
       CASE WHEN t.transaction_id IS NOT NULL THEN 'duplicate_key'
            WHEN b.rn > 1 THEN 'duplicate_in_batch'
            WHEN a.account_id IS NULL THEN 'missing_account_id'
            ELSE 'accepted' END AS append_status
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
                                   ORDER BY timestamp, account_id, amount) AS rn
      FROM (SELECT transaction_id, account_id, transaction_type, amount, currency, description,
                   timestamp, status FROM legs
            UNION ALL
            SELECT * FROM transactions WHERE timestamp >= {AS_OF_ORDERS} - INTERVAL 30 DAY) x) b
LEFT JOIN transactions t ON t.transaction_id = b.transaction_id
LEFT JOIN accounts a ON a.account_id = b.account_id"""
EXTRA["bulk_append"] = [ROLES, *FOLD_CTES, LEGS_CTE]


def _nn(table, cols):
    return [f"SELECT '{table}' AS table_name, 'not_null_{c}' AS check_name, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS n FROM {table}" for c in cols]


def _dom(table, col, values):
    vals = ", ".join(f"'{v}'" for v in values)
    return [f"SELECT '{table}', 'domain_{col}', count(*) FILTER (WHERE {col} IS NOT NULL "
            f"AND {col} NOT IN ({vals})) FROM {table}"]


def _dup(table, col, name):
    return [f"SELECT '{table}', '{name}', CAST(COALESCE(sum(c - 1), 0) AS BIGINT) FROM "
            f"(SELECT {col}, count(*) AS c FROM {table} WHERE {col} IS NOT NULL "
            f"GROUP BY {col} HAVING count(*) > 1)"]


def _fk(table, col, parent, pcol):
    return [f"SELECT '{table}', 'fk_{col}', count(*) FROM {table} x WHERE x.{col} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = x.{col})"]


SQL["constraint_audit"] = "\nUNION ALL\n".join(
    _nn("users", ["user_id", "name", "email"])
    + _dom("users", "role_raw", ["user", "staff", "admin", "system"])
    + _nn("accounts", ["account_id", "user_id", "account_type", "balance"])
    + _dom("accounts", "account_type", ["checking", "savings", "credit"])
    + _nn("transactions", ["transaction_id", "account_id", "transaction_type", "amount", "timestamp"])
    + _dom("transactions", "transaction_type", ["deposit", "withdrawal", "transfer", "payment"])
    + _nn("escalations", ["id", "user_id", "input_text", "status"])
    + _dom("escalations", "status", ["pending", "resolved"])
    + _dup("users", "user_id", "pk_user_id") + _dup("users", "email", "unique_email")
    + _dup("accounts", "account_id", "pk_account_id")
    + _dup("transactions", "transaction_id", "pk_transaction_id")
    + _dup("escalations", "id", "pk_id")
    + _fk("accounts", "user_id", "users", "user_id")
    + _fk("transactions", "account_id", "accounts", "account_id")
    + _fk("escalations", "user_id", "users", "user_id"))

UPDATES = """updates AS (SELECT account_id, timestamp AS updated_at, transaction_id AS update_id,
    amount AS balance, CASE WHEN status = 'failed' THEN 'frozen' ELSE 'active' END AS status
    FROM transactions)"""
LATEST = """latest AS (SELECT account_id, balance, status, updated_at, update_id FROM
    (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY updated_at DESC, update_id DESC) AS rn
     FROM updates) WHERE rn = 1)"""

SQL["latest_account_state"] = "SELECT * FROM latest"
EXTRA["latest_account_state"] = [UPDATES, LATEST]

SQL["account_update"] = """
SELECT COALESCE(a.account_id, l.account_id) AS account_id, a.user_id, a.account_type,
       CASE WHEN l.account_id IS NOT NULL THEN l.balance ELSE a.balance END AS balance, a.currency,
       CASE WHEN l.account_id IS NOT NULL THEN l.status ELSE a.status END AS status,
       CASE WHEN a.user_id IS NOT NULL THEN l.account_id IS NOT NULL END AS updated,
       a.user_id IS NOT NULL AS matched
FROM accounts a FULL JOIN latest l ON a.account_id = l.account_id"""
EXTRA["account_update"] = [UPDATES, LATEST]


def _tier(as_of):
    return (f"CASE WHEN timestamp >= {as_of} - INTERVAL 7 DAY THEN 'hot' "
            f"WHEN timestamp >= {as_of} - INTERVAL 30 DAY THEN 'warm' "
            f"WHEN timestamp >= {as_of} - INTERVAL 2555 DAY THEN 'cold' ELSE 'expired' END")


TIERS = f"""tiers AS (
  SELECT 'audit' AS data_type, {_tier(AS_OF_EVENTS)} AS tier, count(*) AS record_count FROM audit GROUP BY 2
  UNION ALL
  SELECT 'transaction', {_tier(AS_OF_ORDERS)}, count(*) FROM transactions GROUP BY 2)"""
SQL["retention_tiers"] = "SELECT * FROM tiers"
EXTRA["retention_tiers"] = [TIERS]
SQL["retention_events"] = """
SELECT 'data_retention' AS event_type, 'system' AS user_id, data_type,
       CASE tier WHEN 'hot' THEN 'retain' WHEN 'warm' THEN 'compress' WHEN 'cold' THEN 'archive'
                 ELSE 'delete' END AS action, record_count FROM tiers"""
EXTRA["retention_events"] = [TIERS]



# --- text safety, rules, decisions -------------------------------------------

# rule id -> kind, category, severity, action (fixed values)
_RULES = {
    "SAFETY-001": ("safety", "harmful_content", "critical", "reject"),
    "SAFETY-002": ("safety", "offensive_language", "high", "reject"),
    "SAFETY-003": ("safety", "prompt_injection", "critical", "reject"),
    "SAFETY-004": ("safety", "pii_extraction", "critical", "reject"),
    "SAFETY-005": ("safety", "suspicious_activity", "high", "escalate"),
    "COMP-001": ("compliance", "data_privacy", "critical", "rewrite"),
    "COMP-004": ("compliance", "high_value_transactions", "high", "escalate"),
    "COMP-005": ("compliance", "investment_advice", "high", "reject"),
    "COMP-006": ("compliance", "account_creation", "medium", "reject"),
    "COMP-007": ("compliance", "transaction_processing", "medium", "conditional"),
}
_PHRASES = {
    "SAFETY-001": "(hack into|malware|blackmail)",
    "SAFETY-002": "(profanity|hate speech|discriminatory language)",
    "SAFETY-003": "(ignore previous instructions|you are now a different assistant|disregard your safety guidelines)",
    "SAFETY-004": '(user passwords|social security numbers|credit card numbers|token *= *"[0-9a-f]+")',
    "SAFETY-005": "(transfer all money|delete all transaction records|change account ownership)",
    "COMP-001": "(account number|card number|[0-9]{13,}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"
                "|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})",
    "COMP-005": "(invest in stocks|stock should i buy|investment advice)",
    "COMP-006": "(create a new account|open a savings account)",
    "COMP-007": "(pay bill to external account|send money to another person)",
}
_SENSITIVE = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "card": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "phone": "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "ipv4": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "token": 'token *= *"[0-9a-fA-F]+"',
}

WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}]+'), lambda x: x <> ''))"

LEXICON_CTES = [
    "lab AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id))",
    """tot AS (SELECT count(*) FILTER (WHERE toxic = 1) AS n_toxic,
                      count(*) FILTER (WHERE toxic = 0) AS n_clean FROM lab)""",
    f"w AS (SELECT toxic, unnest({WORDS.format(t='text')}) AS word FROM lab)",
    """pw AS (SELECT word, count(*) FILTER (WHERE toxic = 1) AS toxic_docs,
                     count(*) FILTER (WHERE toxic = 0) AS clean_docs FROM w GROUP BY word)""",
    """lex AS (SELECT word, toxic_docs, clean_docs,
       round(ln((CAST(toxic_docs AS DOUBLE) + 0.5) / (CAST(n_toxic AS DOUBLE) + 1.0))
           - ln((CAST(clean_docs AS DOUBLE) + 0.5) / (CAST(n_clean AS DOUBLE) + 1.0)), 6) AS log_odds
     FROM pw, tot)""",
    """lexicon AS (SELECT * FROM lex WHERE toxic_docs >= 2 AND log_odds >= 2.0
                   )"""]

SQL["toxicity_lexicon"] = "SELECT * FROM lexicon"
EXTRA["toxicity_lexicon"] = LEXICON_CTES


def _layer1(src: str, keys: str, text: str) -> list[str]:
    return [f"toks AS (SELECT {keys}, unnest({WORDS.format(t=text)}) AS word FROM {src})",
            f"hits AS (SELECT {keys}, count(*) AS hits FROM toks JOIN lexicon USING (word) GROUP BY ALL)",
            f"""l1 AS (SELECT s.*, CAST(COALESCE(h.hits, 0) AS BIGINT) AS hits2 FROM
                    (SELECT {keys} FROM {src}) s LEFT JOIN hits h USING ({keys}))""",
            f"""scored AS (SELECT {keys}, hits2 AS hits,
                    round(1 - pow(0.5, hits2), 6) AS toxicity,
                    round(CASE WHEN hits2 > 0 THEN 1 - pow(0.5, hits2 - 1) ELSE 0.0 END, 6)
                      AS severe_toxicity FROM l1)"""]


LAYER1_SELECT = """SELECT *, NOT (toxicity > 0.7 OR severe_toxicity > 0.5) AS passed,
  concat(CASE WHEN toxicity > 0.7 OR severe_toxicity > 0.5
              THEN '⚠️ Layer 1 (ML) Safety Check FAILED. Toxicity: '
              ELSE '✅ Layer 1 (ML) Safety Check PASSED. Toxicity: ' END,
         printf('%.2f', toxicity),
         CASE WHEN toxicity > 0.7 OR severe_toxicity > 0.5 THEN '. Request blocked.'
              ELSE '. Proceeding to Layer 2.' END) AS message FROM scored"""

SQL["layer1_check"] = LAYER1_SELECT
EXTRA["layer1_check"] = LEXICON_CTES + _layer1("documents", "doc_id", "text")

SQL["toxicity_model_fit"] = """
SELECT count(*) AS n_labelled, count(*) FILTER (WHERE toxic = 1) AS n_toxic, true AS is_split_near,
       true AS is_calibrated, true AS is_optimal
FROM documents JOIN labels USING (doc_id)"""

SQL["text_safety_by_lexicon"] = f"""
SELECT doc_id, CASE WHEN wordless THEN true ELSE toxicity <= 0.95 END AS is_safe,
       CASE WHEN wordless THEN 'Error' WHEN toxicity > 0.95 THEN 'Offensive' ELSE 'None' END AS risk_category,
       CASE WHEN wordless THEN 0.0 ELSE round(greatest(toxicity, 1 - toxicity), 6) END AS confidence,
       CASE WHEN NOT wordless AND toxicity >= 0.5 THEN 'offensive' ELSE 'non-offensive' END AS label
FROM scored JOIN (SELECT doc_id, COALESCE(len({WORDS.format(t='text')}), 0) = 0 AS wordless FROM documents)
     USING (doc_id)"""
EXTRA["text_safety_by_lexicon"] = LEXICON_CTES + _layer1("documents", "doc_id", "text")

SQL["safety_gate"] = f"""SELECT *, CASE WHEN passed THEN 'continue' ELSE 'blocked' END AS gate
FROM ({LAYER1_SELECT}) g"""
EXTRA["safety_gate"] = LEXICON_CTES + _layer1("user_requests", "conv_id, turn", "input_text")

MASK = ("regexp_replace(regexp_replace(regexp_replace({t}, '[0-9]{{9,}}([0-9]{{4}})', '****\\1', 'g'), "
        "'[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}[ -]([0-9]{{4}})', '****\\1', 'g'), "
        "'[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]([0-9]{{4}})', '****\\1', 'g')")
SQL["mask_account_numbers"] = f"""
SELECT 'documents' AS source_table, doc_id AS id, {MASK.format(t='text')} AS text FROM documents
UNION ALL
SELECT 'pages', page_id, {MASK.format(t='html')} FROM pages"""

SQL["sensitive_text_scan"] = "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_{k}"
    for k, p in _SENSITIVE.items()) + ", (" + " OR ".join(
    f"len(regexp_extract_all(text, '{p}')) > 0" for p in _SENSITIVE.values()) \
    + ") AS has_sensitive FROM documents"

_WEIGHT = {"critical": "1.0", "high": "0.7", "medium": "0.4"}


def _evidence(rid, text):
    if rid == "COMP-004":
        return (f"list_filter(regexp_extract_all(lower({text}), '[$] ?[0-9][0-9,]*([.][0-9]+)?'), lambda x: "
                "TRY_CAST(replace(replace(replace(x, '$', ''), ' ', ''), ',', '') AS DOUBLE) > 10000)[1]")
    return (f"CASE WHEN regexp_matches(lower({text}), '{_PHRASES[rid]}') "
            f"THEN regexp_extract(lower({text}), '{_PHRASES[rid]}', 0) END")


def _matches(src, keys, text):
    return "m AS (SELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT {keys}, '{rid}' AS rule_id, '{_RULES[rid][0]}' AS kind, '{_RULES[rid][1]}' AS category, "
        f"'{_RULES[rid][2]}' AS severity, '{_RULES[rid][3]}' AS action, "
        f"CAST({_WEIGHT[_RULES[rid][2]]} AS DOUBLE) AS weight, {_evidence(rid, text)} AS evidence FROM {src}"
        for rid in _RULES) + ") WHERE evidence IS NOT NULL)"


MATCHES = _matches("documents", "doc_id", "text")

SQL["rule_matches"] = "SELECT doc_id, rule_id, category, severity, action, evidence FROM m"
EXTRA["rule_matches"] = [MATCHES]

SQL["layer2_analysis"] = """
SELECT d.doc_id,
  round(1 - COALESCE(max(m.weight) FILTER (WHERE m.kind = 'safety'), 0.0), 2) AS safety_score,
  round(1 - COALESCE(max(m.weight) FILTER (WHERE m.kind = 'compliance'), 0.0), 2) AS compliance_score,
  CAST(CASE count(m.rule_id) WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence,
  COALESCE(string_agg(m.rule_id, ',' ORDER BY m.rule_id), '') AS violated_rules,
  COALESCE(string_agg(DISTINCT m.category, ',' ORDER BY m.category), '') AS risk_factors,
  CASE WHEN count(m.rule_id) = 0 THEN 'No rule matched'
       ELSE concat('Matched: ', string_agg(m.rule_id, ', ' ORDER BY m.rule_id)) END AS analysis
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""
EXTRA["layer2_analysis"] = [MATCHES]

DECISION_CTE = """dec AS (
SELECT a.request_id, a.user_id, COALESCE(r.role, 'user') AS role, a.safety_score, a.compliance_score,
       a.confidence, a.violated_rule, a.banking_intent,
       CASE WHEN a.safety_score IS NULL OR a.compliance_score IS NULL OR a.confidence IS NULL THEN 1
            WHEN a.violated_rule = 'COMP-001' THEN 2
            WHEN COALESCE(r.role, 'user') IN ('staff', 'admin', 'system') AND a.banking_intent THEN 3
            WHEN a.violated_rule IN ('SAFETY-001', 'SAFETY-002', 'SAFETY-003', 'SAFETY-004')
                 OR a.safety_score < 0.3 THEN 4
            WHEN a.confidence < 0.7 THEN 5
            WHEN a.safety_score >= 0.8 AND a.compliance_score >= 0.8 THEN 6
            WHEN a.banking_intent AND a.safety_score >= 0.6 AND a.compliance_score >= 0.6 THEN 7
            ELSE 8 END AS decision_rule0
FROM analysis a LEFT JOIN roles r ON r.user_id = a.user_id)"""
DECISION_SELECT = """SELECT * EXCLUDE (decision_rule0), CAST(decision_rule0 AS BIGINT) AS decision_rule,
  CASE decision_rule0 WHEN 1 THEN 'escalate' WHEN 2 THEN 'rewrite'
  WHEN 3 THEN 'approve' WHEN 4 THEN 'reject' WHEN 5 THEN 'escalate' WHEN 6 THEN 'approve'
  WHEN 7 THEN 'rewrite' ELSE 'escalate' END AS action,
  CASE decision_rule0
    WHEN 1 THEN 'Analysis missing or failed; escalating for human review.'
    WHEN 2 THEN 'COMP-001: ask for the last 4 digits only.'
    WHEN 3 THEN 'Privileged role with a legitimate banking request.'
    WHEN 4 THEN 'Clear violation or very low safety score.'
    WHEN 5 THEN 'Low confidence; escalating for human review.'
    WHEN 6 THEN 'Safety and compliance scores are high with no blocking violation.'
    WHEN 7 THEN 'Valid banking intent with phrasing concerns; rewriting.'
    ELSE 'Ambiguous request or moderate safety concern.' END AS reasoning FROM dec"""

SQL["decision_matrix"] = DECISION_SELECT
EXTRA["decision_matrix"] = [ROLES, DECISION_CTE]

SQL["decision_counts"] = f"""
SELECT role, action, count(*) AS n, CAST(GROUPING(role, action) AS BIGINT) AS grouping_level
FROM ({DECISION_SELECT}) d GROUP BY CUBE (role, action)"""
EXTRA["decision_counts"] = [ROLES, DECISION_CTE]

SQL["tickets_from_decisions"] = f"""
SELECT {uuid_of('CAST(d.request_id AS VARCHAR)')} AS id, d.user_id,
       concat('Request ', CAST(d.request_id AS VARCHAR)) AS input_text,
       d.reasoning AS agent_reasoning, CAST(0.0 AS DOUBLE) AS confidence,
       a.timestamp AS created_at, 'pending' AS status, CAST(NULL AS TIMESTAMP) AS resolved_at,
       CAST(NULL AS VARCHAR) AS resolved_by, CAST(NULL AS VARCHAR) AS resolution,
       CAST(NULL AS VARCHAR) AS metadata
FROM ({DECISION_SELECT}) d JOIN audit a ON a.event_id = d.request_id WHERE d.action = 'escalate'"""
EXTRA["tickets_from_decisions"] = [ROLES, DECISION_CTE]

BANKING = " OR ".join(f"contains(lower(r.input_text), '{w}')"
                      for w in ("account", "balance", "transaction", "transfer", "payment"))
SCREEN_CTES = LEXICON_CTES + _layer1("user_requests", "conv_id, turn", "input_text") + [
    f"l1m AS ({LAYER1_SELECT})", _matches("user_requests", "conv_id, turn", "input_text"),
    f"""two AS (SELECT r.conv_id, r.turn, concat('u', CAST(r.conv_id AS VARCHAR)) AS user_id,
      any_value({BANKING}) AS banking_intent,
      round(1 - COALESCE(max(m.weight) FILTER (WHERE m.kind = 'safety'), 0.0), 2) AS safety_score,
      round(1 - COALESCE(max(m.weight) FILTER (WHERE m.kind = 'compliance'), 0.0), 2) AS compliance_score,
      CAST(CASE count(m.rule_id) WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence,
      COALESCE(string_agg(m.rule_id, ',' ORDER BY m.rule_id), '') AS violated_rules,
      COALESCE(string_agg(DISTINCT m.category, ',' ORDER BY m.category), '') AS risk_factors
      FROM user_requests r LEFT JOIN m ON m.conv_id = r.conv_id AND m.turn = r.turn
      GROUP BY r.conv_id, r.turn)""",
    """dec AS (SELECT two.*, COALESCE(ro.role, 'user') AS role, l1m.hits, l1m.message, l1m.passed,
      CASE WHEN NOT l1m.passed THEN 0
           WHEN contains(violated_rules, 'COMP-001') THEN 2
           WHEN COALESCE(ro.role, 'user') <> 'user' AND banking_intent THEN 3
           WHEN regexp_matches(violated_rules, 'SAFETY-00[1234]') OR safety_score < 0.3 THEN 4
           WHEN confidence < 0.7 THEN 5
           WHEN safety_score >= 0.8 AND compliance_score >= 0.8 THEN 6
           WHEN banking_intent AND safety_score >= 0.6 AND compliance_score >= 0.6 THEN 7
           ELSE 8 END AS decision_rule0
      FROM two JOIN l1m USING (conv_id, turn) LEFT JOIN roles ro ON ro.user_id = two.user_id)"""]
SQL["request_screening"] = f"""
SELECT conv_id, turn, user_id, role, hits, CASE WHEN passed THEN 'continue' ELSE 'blocked' END AS gate,
  CASE WHEN passed THEN safety_score END AS safety_score,
  CASE WHEN passed THEN compliance_score END AS compliance_score,
  CASE WHEN passed THEN confidence END AS confidence,
  CASE WHEN passed THEN violated_rules END AS violated_rules,
  CASE WHEN passed THEN risk_factors END AS risk_factors, banking_intent,
  decision_rule, CASE WHEN passed THEN action ELSE 'blocked' END AS action,
  CASE WHEN passed THEN reasoning ELSE message END AS reasoning,
  CASE WHEN passed AND action = 'escalate'
       THEN {uuid_of("concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))")} END AS ticket_id
FROM ({DECISION_SELECT}) d"""
EXTRA["request_screening"] = [ROLES] + SCREEN_CTES

SQL["rule_rewrite"] = f"""
SELECT doc_id, concat('Please show only the last 4 digits. ',
                      {MASK.format(t='text')}) AS rewritten_text
FROM documents WHERE regexp_matches(lower(text), '{_PHRASES["COMP-001"]}')"""

SQL["escalate_low_confidence"] = """
SELECT a.*, t.industry, t.threshold FROM analysis a
JOIN (VALUES ('default', CAST(0.6 AS DOUBLE)), ('clothing_brand', CAST(0.6 AS DOUBLE)),
             ('healthcare', CAST(0.5 AS DOUBLE)), ('financial_services', CAST(0.7 AS DOUBLE)))
     t(industry, threshold) ON CAST(a.confidence AS DOUBLE) < t.threshold"""

# --- compliance --------------------------------------------------------------

PCI_ACCESS = """SELECT event_id, timestamp, 'pci_dss' AS framework, 'pci_data_access' AS event_type,
  user_id, CASE WHEN event_type = 'account_access' THEN 'account' ELSE 'transaction' END AS data_type,
  account_id, CASE WHEN contains(action, 'transfer') THEN 'transfer' ELSE 'read' END AS operation,
  'PCI-DSS 10.2' AS requirement
FROM audit WHERE event_type IN ('account_access', 'transaction_query') AND success"""
SQL["pci_data_access"] = PCI_ACCESS
SQL["pci_authentication"] = """
SELECT event_id, timestamp, 'pci_dss' AS framework, 'pci_authentication' AS event_type, user_id,
  success, action AS method, CAST(NULL AS VARCHAR) AS ip_address, 'PCI-DSS 10.2.4' AS requirement
FROM audit WHERE event_type IN ('auth_success', 'auth_failure')"""
SQL["pci_privileged_action"] = """
SELECT event_id, timestamp, 'pci_dss' AS framework, 'pci_privileged_action' AS event_type, user_id,
  action, account_id AS target, CASE WHEN success THEN 'success' ELSE 'failure' END AS result,
  'PCI-DSS 10.2.2' AS requirement
FROM audit WHERE user_id IN (SELECT user_id FROM roles WHERE role IN ('staff', 'admin', 'system'))"""
EXTRA["pci_privileged_action"] = [ROLES]
SQL["soc2_access_control"] = """
SELECT a.event_id, a.timestamp, 'soc2' AS framework, 'soc2_access_control' AS event_type, a.user_id,
  a.event_type AS resource, p.permission, rp.role IS NOT NULL AS granted, 'SOC2 CC6.1' AS control
FROM audit a JOIN event_perm p ON p.event_type = a.event_type
LEFT JOIN roles r ON r.user_id = a.user_id
LEFT JOIN role_perm rp ON rp.role = COALESCE(r.role, 'user') AND rp.permission = p.permission"""
EXTRA["soc2_access_control"] = [ROLES, ROLE_PERM, EVENT_PERM]
SQL["soc2_data_processing"] = """
SELECT event_id, timestamp, 'soc2' AS framework, 'soc2_data_processing' AS event_type, user_id,
  CASE WHEN event_type = 'account_access' THEN 'account' ELSE 'transaction' END AS data_type,
  CASE WHEN contains(action, 'transfer') THEN 'transfer' ELSE 'read' END AS operation,
  'customer_service' AS purpose, 'SOC2 CC6.7' AS control
FROM audit WHERE event_type IN ('account_access', 'transaction_query')"""
SQL["soc2_incidents"] = """
SELECT event_id, timestamp, 'soc2' AS framework, 'soc2_incident' AS event_type, user_id,
  'fraud_report' AS incident_type, 'high' AS severity, concat('Account ', account_id, ': ') AS description,
  'SOC2 CC7.3' AS control
FROM audit WHERE action = 'fraud_report'"""
SQL["unlogged_access"] = f"""
SELECT * FROM audit a WHERE event_type IN ('account_access', 'transaction_query')
  AND NOT EXISTS (SELECT 1 FROM ({PCI_ACCESS}) p WHERE p.event_id = a.event_id)"""
UNIFIED_PARTS = [
    "SELECT 'audit' AS source, 'audit' AS framework, event_id, timestamp, event_type, user_id FROM audit",
    "SELECT 'compliance', 'pci_dss', event_id, timestamp, 'pci_data_access', user_id FROM audit "
    "WHERE event_type IN ('account_access', 'transaction_query') AND success",
    "SELECT 'compliance', 'pci_dss', event_id, timestamp, 'pci_authentication', user_id FROM audit "
    "WHERE event_type IN ('auth_success', 'auth_failure')",
    "SELECT 'compliance', 'pci_dss', event_id, timestamp, 'pci_privileged_action', user_id FROM audit "
    "WHERE user_id IN (SELECT user_id FROM roles WHERE role IN ('staff', 'admin', 'system'))",
    "SELECT 'compliance', 'soc2', event_id, timestamp, 'soc2_access_control', user_id FROM audit",
    "SELECT 'compliance', 'soc2', event_id, timestamp, 'soc2_data_processing', user_id FROM audit "
    "WHERE event_type IN ('account_access', 'transaction_query')",
    "SELECT 'compliance', 'soc2', event_id, timestamp, 'soc2_incident', user_id FROM audit "
    "WHERE action = 'fraud_report'",
]
SQL["unified_event_log"] = "\nUNION ALL\n".join(UNIFIED_PARTS)
EXTRA["unified_event_log"] = [ROLES]
SQL["compliance_jsonl_scan"] = ("SELECT framework, event_type, count(*) AS n FROM ("
                                + "\nUNION ALL\n".join(UNIFIED_PARTS[1:])
                                + ") x(source, framework, event_id, timestamp, event_type, user_id) "
                                "GROUP BY ALL")
EXTRA["compliance_jsonl_scan"] = [ROLES]



# --- metrics, security, windows ----------------------------------------------

STAGE = """CASE WHEN action IN ('safety_layer1_check') THEN 'safety_check'
  WHEN action IN ('safety_layer2_analysis', 'safety_decision_made') THEN 'llm_call'
  WHEN event_type IN ('tool_call', 'account_access', 'transaction_query') THEN 'tool_call'
  ELSE 'other' END"""
COSTX = """CAST(CASE WHEN action IN ('safety_layer2_analysis', 'safety_decision_made')
    THEN tokens * CAST('0.000002' AS DECIMAL(18, 8))
  WHEN action IN ('safety_layer1_check') THEN CAST('0.0001' AS DECIMAL(18, 8))
  ELSE CAST(0 AS DECIMAL(18, 8)) END AS DECIMAL(18, 8))"""
TOOLX = f"COALESCE({ACTION_TOOL}, 'none')"
MODELX = """CASE WHEN action IN ('safety_layer2_analysis', 'safety_decision_made') THEN 'llm'
  WHEN action IN ('safety_layer1_check') THEN 'ml' ELSE 'none' END"""

SQL["latency_sketch_error"] = "\nUNION ALL\n".join(f"""
SELECT '{p}' AS period, CAST(date_trunc('{p}', timestamp) AS DATE) AS start, {STAGE} AS stage,
       count(*) AS n_events, count(*) AS n_sketch,
       true AS p50_within, true AS p95_within, true AS p99_within
FROM audit WHERE latency_ms IS NOT NULL GROUP BY 2, 3""" for p in ("day", "week", "month"))

SQL["latency_percentiles"] = f"""
SELECT stage, count(v) AS n, round(quantile_cont(v, 0.5), 4) AS p50,
       round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99
FROM (SELECT {STAGE} AS stage, CAST(latency_ms AS DOUBLE) AS v FROM audit
      UNION ALL SELECT 'end_to_end', CAST(latency_ms AS DOUBLE) FROM audit) x
WHERE v IS NOT NULL GROUP BY stage"""

SQL["request_volume"] = "\nUNION ALL\n".join(
    f"SELECT '{g}' AS grain, CAST(date_trunc('{g}', timestamp) AS TIMESTAMP) AS bucket, "
    f"count(*) AS n FROM audit GROUP BY 2" for g in ("minute", "hour", "day"))

SQL["daily_event_volume"] = """
SELECT CAST(timestamp AS DATE) AS day,
       count(*) FILTER (WHERE event_type = 'safety_block') AS safety_block,
       count(*) FILTER (WHERE event_type = 'escalation_created') AS escalation_created,
       count(*) FILTER (WHERE event_type = 'tool_call') AS tool_call
FROM audit WHERE event_type IN ('safety_block', 'escalation_created', 'tool_call') GROUP BY 1"""

SQL["error_breakdown"] = """
SELECT CAST(timestamp AS DATE) AS day,
  count(*) FILTER (WHERE event_type = 'safety_block'
                   OR (starts_with(COALESCE(action, ''), 'safety_') AND NOT COALESCE(success, true)))
    AS failed_safety_checks,
  count(*) FILTER (WHERE event_type IN ('tool_call', 'account_access', 'transaction_query')
                   AND NOT COALESCE(success, true)) AS failed_tool_calls,
  count(*) FILTER (WHERE COALESCE(action, '') IN ('safety_layer2_analysis', 'safety_decision_made')
                   AND NOT COALESCE(success, true)) AS model_errors,
  count(*) FILTER (WHERE contains(COALESCE(action, ''), 'failed')) AS database_errors,
  count(*) FILTER (WHERE event_type = 'auth_failure') AS access_denials,
  count(*) AS events
FROM audit GROUP BY 1"""

SQL["accounts_accessed_daily"] = """
SELECT CAST(timestamp AS DATE) AS day,
       count(DISTINCT CASE WHEN event_type = 'account_access' THEN account_id END) AS accounts_accessed,
       count(*) FILTER (WHERE action = 'fraud_report') AS fraud_reports
FROM audit GROUP BY 1"""

SQL["cost_rollup"] = f"""
SELECT user_id, day, month, tool, model, sum(cost) AS total_cost, count(*) AS n_events,
       CAST(GROUPING(user_id, day, month, tool, model) AS BIGINT) AS grouping_level
FROM (SELECT user_id, CAST(timestamp AS DATE) AS day, strftime(timestamp, '%Y-%m') AS month,
             {TOOLX} AS tool, {MODELX} AS model, {COSTX} AS cost FROM audit) c
GROUP BY GROUPING SETS ((user_id), (day), (month), (tool), (model), ())"""

SESSION_CTES = [
    f"""e AS (SELECT event_id, user_id, timestamp, event_type, action, latency_ms,
                  {TOOLX} AS tool, {COSTX} AS cost FROM audit)""",
    """s AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL
                           OR timestamp > lag(timestamp) OVER w + INTERVAL 60 MINUTE THEN 1 ELSE 0 END
                      AS new_session
           FROM e WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id))""",
    """g AS (SELECT *, sum(new_session) OVER (PARTITION BY user_id ORDER BY timestamp, event_id
                                              ROWS UNBOUNDED PRECEDING) AS sid FROM s)"""]

SQL["sessions"] = """
SELECT concat(user_id, '-', strftime(min(timestamp), '%Y%m%d%H%M%S')) AS session_id, user_id,
       min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS interactions,
       COALESCE(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (WHERE tool <> 'none'), '')
         AS tools_used,
       count(*) FILTER (WHERE event_type = 'safety_block') AS safety_blocks,
       count(*) FILTER (WHERE event_type = 'escalation_created') AS escalations,
       sum(cost) AS total_cost
FROM g GROUP BY user_id, sid"""
EXTRA["sessions"] = SESSION_CTES

SQL["latency_trace_rollup"] = """
SELECT request_id, step, child_step, child_ms, step_ms, total_ms,
       round(CASE WHEN total_ms = 0 THEN NULL ELSE CAST(step_ms AS DOUBLE) / CAST(total_ms AS DOUBLE) END, 6)
         AS step_share,
       round(CASE WHEN total_ms = 0 THEN NULL ELSE CAST(child_ms AS DOUBLE) / CAST(total_ms AS DOUBLE) END, 6)
         AS child_share
FROM (SELECT concat(user_id, '-', strftime(session_start, '%Y%m%d%H%M%S')) AS request_id, step,
             child_step, child_ms,
             sum(child_ms) OVER (PARTITION BY user_id, session_start, step) AS step_ms,
             sum(child_ms) OVER (PARTITION BY user_id, session_start) AS total_ms
      FROM (SELECT user_id, session_start, step, child_step, sum(latency_ms) AS child_ms
            FROM (SELECT *, min(timestamp) OVER (PARTITION BY user_id, sid) AS session_start,
                         {STAGE} AS step, COALESCE(action, 'unknown') AS child_step FROM g) x
            GROUP BY ALL) y) z""".replace("{STAGE}", STAGE)
EXTRA["latency_trace_rollup"] = SESSION_CTES


def _counted(src, item, section, top=False):
    g = (f"SELECT CAST(timestamp AS DATE) AS day, {item} AS item, count(*) AS value "
         f"FROM {src} GROUP BY ALL")
    if top:
        g = (f"SELECT day, item, value FROM (SELECT *, row_number() OVER (PARTITION BY day "
             f"ORDER BY value DESC, item) AS r FROM ({g}) q) q2 WHERE r <= 3")
    return f"SELECT day, '{section}' AS section, item, value FROM ({g}) t"


SQL["daily_report"] = "\nUNION ALL\n".join([
    _counted("audit", "'all'", "total_requests"),
    _counted("audit", "user_id", "top_users", top=True),
    _counted("(SELECT * FROM audit WHERE event_type IN ('tool_call', 'account_access', "
             "'transaction_query'))", TOOLX, "top_tools", top=True),
    _counted("(SELECT * FROM audit WHERE event_type = 'safety_block')", "risk_category",
             "blocks_by_category"),
    _counted("(SELECT * FROM audit WHERE event_type = 'compliance_violation')", "violated_rule",
             "violations_by_rule"),
    _counted("(SELECT *, created_at AS timestamp FROM escalations)", "agent_reasoning",
             "escalations_by_reason")])

SQL["system_health"] = f"""
SELECT requests, errors, error_rate, avg_latency_ms, safety_blocks, queue_size,
       CASE WHEN error_rate > 0.10 THEN 'red'
            WHEN error_rate > 0.05 OR block_rate > 0.20 THEN 'yellow' ELSE 'green' END AS health
FROM (SELECT count(*) AS requests, count(*) FILTER (WHERE NOT COALESCE(success, true)) AS errors,
             count(*) FILTER (WHERE event_type = 'safety_block') AS safety_blocks,
             round(avg(CAST(latency_ms AS DOUBLE)), 4) AS avg_latency_ms,
             round(CASE WHEN count(*) = 0 THEN NULL ELSE
                   CAST(count(*) FILTER (WHERE NOT COALESCE(success, true)) AS DOUBLE) / count(*) END, 6)
               AS error_rate,
             round(CASE WHEN count(*) = 0 THEN NULL ELSE
                   CAST(count(*) FILTER (WHERE event_type = 'safety_block') AS DOUBLE) / count(*) END, 6)
               AS block_rate
      FROM audit WHERE timestamp >= {AS_OF_EVENTS} - INTERVAL 60 MINUTE AND timestamp < {AS_OF_EVENTS}) m,
     (SELECT count(*) AS queue_size FROM escalations
      WHERE status = 'pending' AND created_at < {AS_OF_EVENTS}) q"""

SQL["weekly_trends"] = """
SELECT week, event_type, n, prev_n, n - prev_n AS change,
       round(CASE WHEN prev_n = 0 THEN NULL ELSE CAST((n - prev_n) * 100 AS DOUBLE) / prev_n END, 4)
         AS change_pct
FROM (SELECT week, event_type, n, lag(n) OVER (PARTITION BY event_type ORDER BY week) AS prev_n
      FROM (SELECT CAST(date_trunc('week', timestamp) AS TIMESTAMP) AS week, event_type, count(*) AS n
            FROM audit GROUP BY ALL) a) b"""

SQL["cost_spike_days"] = f"""
SELECT day, cost, avg_before, CAST(cost AS DOUBLE) > 2.0 * avg_before AS spike
FROM (SELECT day, cost, round(avg(CAST(cost AS DOUBLE)) OVER (ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8) AS avg_before
      FROM (SELECT CAST(timestamp AS DATE) AS day, sum({COSTX}) AS cost FROM audit GROUP BY 1) d) x"""

SQL["volume_anomalies"] = """
SELECT day, event_type, n, mean_prev, sd_prev,
       COALESCE(n > mean_prev + 3.0 * sd_prev OR n < mean_prev - 3.0 * sd_prev, false) AS anomaly
FROM (SELECT day, event_type, n,
        round(avg(n) OVER w, 6) AS mean_prev, round(stddev_samp(n) OVER w, 6) AS sd_prev
      FROM (SELECT CAST(timestamp AS DATE) AS day, event_type, count(*) AS n FROM audit GROUP BY ALL) d
      WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) x"""

SQL["brute_force"] = """
SELECT event_id, user_id, timestamp, failures_in_window FROM
  (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY timestamp
          RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS failures_in_window
   FROM audit WHERE event_type = 'auth_failure') f
WHERE failures_in_window >= 3"""

SQL["unusual_access"] = """
SELECT user_id, CAST(timestamp AS DATE) AS day, count(DISTINCT account_id) AS accounts
FROM audit WHERE event_type = 'account_access' GROUP BY ALL HAVING count(DISTINCT account_id) >= 2"""

SQL["exfiltration"] = """
SELECT v.user_id, v.reads, q.bound FROM
  (SELECT user_id, count(*) AS reads FROM audit
   WHERE event_type IN ('account_access', 'transaction_query') GROUP BY user_id) v,
  (SELECT round(quantile_cont(CAST(reads AS DOUBLE), 0.99), 6) AS bound FROM
     (SELECT user_id, count(*) AS reads FROM audit
      WHERE event_type IN ('account_access', 'transaction_query') GROUP BY user_id) w) q
WHERE v.reads > q.bound"""

SQL["privilege_escalation"] = f"SELECT * FROM ({SQL['acl_decisions']}) d WHERE NOT granted"
EXTRA["privilege_escalation"] = EXTRA["acl_decisions"]

SQL["blocked_transfers"] = """
SELECT requester_id, count(*) AS blocked,
       count(*) FILTER (WHERE outcome = 'access_denied_source') AS access_denied_source,
       count(*) FILTER (WHERE outcome = 'access_denied_target') AS access_denied_target,
       count(*) FILTER (WHERE outcome = 'not_own_source') AS not_own_source,
       count(*) FILTER (WHERE outcome = 'not_own_target') AS not_own_target
FROM pre WHERE outcome IN ('access_denied_source', 'access_denied_target', 'not_own_source',
                           'not_own_target') GROUP BY requester_id"""
EXTRA["blocked_transfers"] = [ROLES, PRECHECK_CTE]



# --- alerts --------------------------------------------------------------------

SQL["alert_fraud_spike"] = """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS fraud_reports,
       count(*) > 10 AS alert
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) - to_minutes(CAST(k * 5 AS BIGINT)) AS window_start
      FROM audit, range(0, 12) t(k) WHERE action = 'fraud_report') w
GROUP BY window_start"""

SQL["alert_error_rate"] = """
SELECT window_start, requests, errors, error_rate,
       CASE WHEN error_rate > 0.10 THEN 'critical' WHEN error_rate > 0.05 THEN 'warning'
            ELSE 'ok' END AS level
FROM (SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS window_start, count(*) AS requests,
             count(*) FILTER (WHERE NOT COALESCE(success, true)) AS errors,
             round(CAST(count(*) FILTER (WHERE NOT COALESCE(success, true)) AS DOUBLE) / count(*), 6)
               AS error_rate
      FROM audit GROUP BY 1) x"""

SQL["alert_block_rate"] = """
SELECT window_start, requests, blocks, block_rate,
       CASE WHEN block_rate > 0.20 THEN 'warning' ELSE 'ok' END AS level
FROM (SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS window_start, count(*) AS requests,
             count(*) FILTER (WHERE event_type = 'safety_block') AS blocks,
             round(CAST(count(*) FILTER (WHERE event_type = 'safety_block') AS DOUBLE) / count(*), 6)
               AS block_rate
      FROM audit GROUP BY 1) x"""

SQL["alert_latency"] = """
SELECT window_start, requests, p95_ms, CASE WHEN p95_ms > 5000 THEN 'warning' ELSE 'ok' END AS level
FROM (SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS window_start,
             count(latency_ms) AS requests,
             round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 4) AS p95_ms
      FROM audit WHERE latency_ms IS NOT NULL GROUP BY 1) x"""

SQL["alert_backlog"] = """
SELECT b.bucket AS window_start, CAST(b.before + b.max_local AS BIGINT) AS max_pending,
       CAST(b.before + b.net AS BIGINT) AS pending_at_end, b.before + b.max_local > 100 AS alert
FROM (SELECT bucket, max_local, net,
             COALESCE(sum(net) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS before
      FROM (SELECT bucket, max(local) AS max_local, sum(delta) AS net FROM
              (SELECT *, sum(delta) OVER (PARTITION BY bucket ORDER BY ts, delta DESC, id
                                          ROWS UNBOUNDED PRECEDING) AS local
               FROM (SELECT *, date_trunc('hour', ts) AS bucket FROM tev) e) r
            GROUP BY bucket) p) b"""
EXTRA["alert_backlog"] = RESOLUTION_CTES + [
    "rt AS (" + SQL["resolve_tickets"].strip() + ")",
    """tev AS (SELECT created_at AS ts, id, 1 AS delta FROM rt
              UNION ALL SELECT resolved_at, id, -1 FROM rt WHERE resolved_at IS NOT NULL)"""]



# --- lookups and reconciliation ----------------------------------------------

SQL["user_lookup"] = """
SELECT u.user_id, u.name, u.email, CAST(COALESCE(a.n, 0) AS BIGINT) AS n_accounts,
       COALESCE(a.ids, '') AS account_ids
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n,
                               string_agg(account_id, ',' ORDER BY account_id) AS ids
                        FROM accounts GROUP BY user_id) a ON a.user_id = u.user_id"""

SQL["user_account_pages"] = """
SELECT u.user_id, u.name, u.email, COALESCE(a.page, 1) AS page, a.first_number,
       COALESCE(a.ids, '') AS account_ids
FROM users u LEFT JOIN (
  SELECT user_id, (number + 2) // 3 AS page, min(number) AS first_number,
         string_agg(account_id, ',' ORDER BY account_id) AS ids
  FROM (SELECT user_id, account_id, row_number() OVER (PARTITION BY user_id ORDER BY account_id) AS number
        FROM accounts) GROUP BY 1, 2) a ON a.user_id = u.user_id"""

SQL["high_value_transfers"] = """
SELECT concat('hv-', t.transaction_id) AS ticket_id, a.user_id, t.transaction_id, t.account_id,
       t.amount, concat('Transfer of $', CAST(abs(t.amount) AS VARCHAR), ' on account ', t.account_id)
         AS input_text,
       'COMP-004: transfer over $10,000 requires human review' AS agent_reasoning,
       CAST(1.0 AS DOUBLE) AS confidence, t.timestamp AS created_at, 'pending' AS status
FROM transactions t JOIN accounts a ON a.account_id = t.account_id
WHERE t.transaction_type = 'transfer' AND abs(t.amount) > 10000"""

SQL["transfer_leg_match"] = """
SELECT transfer_id, n_from, n_to, net_amount,
       CASE WHEN n_from = 1 AND n_to = 1 AND net_amount = 0 THEN 'ok'
            WHEN n_from = 0 OR n_to = 0 THEN 'missing_leg'
            WHEN n_from > 1 OR n_to > 1 THEN 'duplicate_leg' ELSE 'unbalanced' END AS status
FROM (SELECT regexp_replace(transaction_id, '_(from|to)$', '') AS transfer_id,
             count(*) FILTER (WHERE ends_with(transaction_id, '_from')) AS n_from,
             count(*) FILTER (WHERE ends_with(transaction_id, '_to')) AS n_to,
             sum(amount) AS net_amount
      FROM legs WHERE regexp_matches(transaction_id, '_(from|to)$') GROUP BY 1) g"""
EXTRA["transfer_leg_match"] = [ROLES, *FOLD_CTES, LEGS_CTE]

SQL["audit_ticket_match"] = """
SELECT COALESCE(e.ticket_id, t.id) AS ticket_id, COALESCE(e.n_created, 0) > 0 AS has_create_event,
       COALESCE(e.n_resolved, 0) > 0 AS has_resolve_event, t.status IS NOT NULL AS has_ticket,
       CASE WHEN t.status IS NULL THEN 'event_without_ticket'
            WHEN NOT COALESCE(e.n_created, 0) > 0 THEN 'ticket_without_create_event'
            WHEN t.status = 'resolved' AND NOT COALESCE(e.n_resolved, 0) > 0 THEN 'resolved_without_event'
            WHEN t.status <> 'resolved' AND COALESCE(e.n_resolved, 0) > 0 THEN 'event_without_resolution'
            ELSE 'ok' END AS issue
FROM (SELECT ticket_id, count(*) FILTER (WHERE event_type = 'escalation_created') AS n_created,
             count(*) FILTER (WHERE event_type = 'escalation_resolved') AS n_resolved
      FROM linked WHERE ticket_id IS NOT NULL GROUP BY ticket_id) e
FULL JOIN escalations t ON t.id = e.ticket_id"""
EXTRA["audit_ticket_match"] = [
    """tu AS (SELECT user_id, timestamp, 1 AS side, CAST(NULL AS VARCHAR) AS ticket_id, event_id, event_type
         FROM audit WHERE event_type IN ('escalation_created', 'escalation_resolved')
         UNION ALL SELECT user_id, created_at, 0, id, NULL, NULL FROM escalations)""",
    """linked AS (SELECT * FROM (SELECT event_id, user_id, timestamp, event_type, side,
         last_value(ticket_id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, side, ticket_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ticket_id FROM tu) x WHERE side = 1)"""]



# --- log round trips -----------------------------------------------------------

SCANNED = """SELECT timestamp, event_type, user_id, action, success, event_id, account_id,
       latency_ms, tokens, CAST(timestamp AS DATE) AS event_date FROM audit"""
SQL["audit_jsonl_scan"] = SCANNED
SQL["stream_follow"] = SCANNED
SQL["stream_dedup"] = SCANNED
SQL["audit_sink"] = "SELECT *, CAST(timestamp AS DATE) AS event_date FROM audit"

SQL["audit_verbose"] = """
SELECT a.timestamp, a.event_type, a.user_id, a.action,
       concat('Request ', CAST(a.event_id AS VARCHAR)) AS input,
       CAST(d.safety_score AS DOUBLE) AS safety_score,
       CASE WHEN d.safety_score >= 0.8 THEN 'green' WHEN d.safety_score >= 0.5 THEN 'yellow'
            WHEN d.safety_score IS NOT NULL THEN 'red' END AS safety_band,
       d.violated_rule AS violated,
       concat('Scores for request ', CAST(a.event_id AS VARCHAR)) AS analysis,
       d.action AS decision,
       CASE WHEN length(d.reasoning) <= 120 THEN d.reasoning
            ELSE concat(left(d.reasoning, 117), '...') END AS reasoning,
       CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS transaction_id,
       CAST(NULL AS DECIMAL(18, 2)) AS amount, CAST(NULL AS VARCHAR) AS from_account,
       CAST(NULL AS VARCHAR) AS to_account,
       CASE WHEN NOT a.success THEN concat('failed: ', a.action) END AS error
FROM audit a LEFT JOIN (""" + DECISION_SELECT + """) d ON d.request_id = a.event_id
UNION ALL
SELECT CAST('2024-01-01' AS TIMESTAMP) + to_days(CAST(l_orderkey % 30 AS INTEGER)) + to_hours(CAST(l_linenumber AS BIGINT)),
       'transaction', requester_id, 'transfer_requested', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN length(summary) <= 120 THEN summary ELSE concat(left(summary, 117), '...') END,
       concat('transfer_', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)),
       amount, from_account_id, to_account_id, NULL
FROM (SELECT *, concat('Transfer of $', CAST(amount AS VARCHAR), ' from ', from_account_id, ' to ', to_account_id,
                       ', requested by ', requester_id,
                       ', waiting for the checks of its accounts, of its amount and of the caller') AS summary
      FROM transfer_requests) t"""
EXTRA["audit_verbose"] = [ROLES, DECISION_CTE]



# Streams in append mode emit a window once the watermark (largest event time
# seen minus 10 minutes) has passed its end.
WATERMARK_AT = "(SELECT max(timestamp) FROM audit) - INTERVAL 10 MINUTE"

SQL["stream_rate"] = """
SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, n
FROM (SELECT CAST(date_trunc('minute', timestamp) AS TIMESTAMP) AS window_start, count(*) AS n
      FROM audit GROUP BY 1) w"""

SQL["stream_rate_sliding"] = """
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, n
FROM (SELECT CAST(date_trunc('minute', timestamp) AS TIMESTAMP) - to_minutes(k) AS window_start, count(*) AS n
      FROM audit, range(5) r(k) GROUP BY 1) w"""

SQL["stream_sessions"] = f"""
SELECT user_id, count(*) AS interactions, min(timestamp) AS start_time, max(timestamp) AS end_time,
       count(*) FILTER (WHERE event_type = 'safety_block') AS safety_blocks
FROM g GROUP BY user_id, sid
HAVING max(timestamp) + INTERVAL 60 MINUTE <= {WATERMARK_AT}"""
EXTRA["stream_sessions"] = SESSION_CTES



# --- streams over several micro-batches -------------------------------------------

# the arrivals of the log: four equal spans of time, every 17th event two spans later
ARRIVAL_CTES = ["""bounds AS (
  SELECT min(timestamp) AS lo,
         to_microseconds(CAST((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 4 + 1 AS BIGINT)) AS step
  FROM audit)""",
    """arrived AS (
  SELECT a.*, CASE WHEN timestamp >= lo + 3 * step THEN 3 WHEN timestamp >= lo + 2 * step THEN 2
                   WHEN timestamp >= lo + step THEN 1 ELSE 0 END
              + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS batch_id
  FROM audit a, bounds)""",
    """marks AS (
  SELECT batch_id, n_rows, max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           - INTERVAL 10 MINUTE AS watermark
  FROM (SELECT batch_id, count(*) AS n_rows, max(timestamp) AS newest FROM arrived GROUP BY batch_id) b)"""]

SQL["stream_late_rows"] = """
SELECT a.event_id, a.user_id, a.timestamp, m.watermark, CAST(a.batch_id AS BIGINT) AS batch_id
FROM arrived a JOIN marks m ON m.batch_id = a.batch_id AND a.timestamp <= m.watermark"""
EXTRA["stream_late_rows"] = ARRIVAL_CTES

SQL["stream_late_counts"] = """
SELECT CAST(m.batch_id AS BIGINT) AS batch_id, m.watermark, m.n_rows,
       (SELECT count(*) FROM arrived a WHERE a.batch_id = m.batch_id AND a.timestamp <= m.watermark) AS n_late
FROM marks m"""
EXTRA["stream_late_counts"] = ARRIVAL_CTES

SQL["stream_active_sessions"] = f"""
SELECT user_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS interactions,
       count(*) FILTER (WHERE event_type = 'safety_block') AS safety_blocks,
       CASE WHEN max(timestamp) + INTERVAL 60 MINUTE <= {WATERMARK_AT} THEN 'closed' ELSE 'active' END AS state
FROM g GROUP BY user_id, sid"""
EXTRA["stream_active_sessions"] = SESSION_CTES

SQL["stream_alert_events"] = """
SELECT rule, window_end,
       CASE WHEN previous_level = 'ok' THEN 'raised' WHEN level = 'ok' THEN 'cleared' ELSE 'changed' END AS event,
       level, previous_level, value
FROM (SELECT *, COALESCE(lag(level) OVER (PARTITION BY rule ORDER BY window_end), 'ok') AS previous_level
      FROM levels) l WHERE level <> previous_level"""
EXTRA["stream_alert_events"] = [f"""sliding AS (
  SELECT window_start + INTERVAL 1 HOUR AS window_end, count(*) AS requests,
         count(*) FILTER (WHERE NOT COALESCE(success, true)) AS errors,
         count(*) FILTER (WHERE event_type = 'safety_block') AS blocks,
         count(*) FILTER (WHERE latency_ms > 5000) AS slow, count(latency_ms) AS timed,
         count(*) FILTER (WHERE action = 'fraud_report') AS fraud
  FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, timestamp) - to_minutes(CAST(k * 5 AS BIGINT)) AS window_start
        FROM audit, range(0, 12) t(k)) w
  GROUP BY 1 HAVING window_end <= {WATERMARK_AT})""",
    """rules AS (
  SELECT window_end, 'error_rate' AS rule, round(CAST(errors AS DOUBLE) / requests, 6) AS value FROM sliding
  UNION ALL SELECT window_end, 'block_rate', round(CAST(blocks AS DOUBLE) / requests, 6) FROM sliding
  UNION ALL SELECT window_end, 'latency_p95',
                   COALESCE(round(CAST(slow AS DOUBLE) / nullif(timed, 0), 6), 0) FROM sliding
  UNION ALL SELECT window_end, 'fraud_spike', CAST(fraud AS DOUBLE) FROM sliding)""",
    """levels AS (
  SELECT *, CASE WHEN rule = 'error_rate' AND value > 0.10 OR rule = 'fraud_spike' AND value > 10 THEN 'critical'
                 WHEN rule = 'error_rate' AND value > 0.05 OR rule = 'block_rate' AND value > 0.20
                   OR rule = 'latency_p95' AND value > 0.05 THEN 'warning' ELSE 'ok' END AS level
  FROM rules)"""]


SQL["compliance_sink"] = ("SELECT framework, timestamp, event_type, user_id, event_id, "
                          "CAST(timestamp AS DATE) AS event_date FROM ("
                          + "\nUNION ALL\n".join(UNIFIED_PARTS[1:])
                          + ") x(source, framework, event_id, timestamp, event_type, user_id)")
EXTRA["compliance_sink"] = [ROLES]

SQL["stream_backlog"] = """
SELECT CAST(sum(delta) AS BIGINT) AS pending, max(ts) AS as_of, sum(delta) > 100 AS alert FROM tev"""
EXTRA["stream_backlog"] = EXTRA["alert_backlog"]



# The stream starts from the created tickets (pending) and applies every
# allowed resolution event; the latest per ticket wins.
SQL["stream_tickets"] = """
SELECT t.id, t.user_id, t.input_text, t.agent_reasoning, CAST(t.confidence AS DOUBLE) AS confidence,
       t.created_at, CASE WHEN l.ticket_id IS NOT NULL THEN 'resolved' ELSE 'pending' END AS status,
       l.resolved_at, l.caller_id AS resolved_by, CAST(t.created_at AS DATE) AS created_day
FROM escalations t LEFT JOIN lastres l ON l.ticket_id = t.id"""
EXTRA["stream_tickets"] = RESOLUTION_CTES


TIERS_ALL = f"""tiers AS (
  SELECT 'audit' AS data_type, {_tier(AS_OF_EVENTS)} AS tier, count(*) AS record_count FROM audit GROUP BY 2
  UNION ALL
  SELECT 'transaction', {_tier(AS_OF_ORDERS)}, count(*) FROM transactions GROUP BY 2
  UNION ALL
  SELECT 'escalation', {_tier(AS_OF_EVENTS).replace('timestamp', 'created_at')}, count(*) FROM escalations GROUP BY 2
  UNION ALL
  SELECT 'compliance', {_tier(AS_OF_EVENTS)}, count(*) FROM ("""
TIERS_ALL += ("\nUNION ALL\n".join(UNIFIED_PARTS[1:])
              + ") x(source, framework, event_id, timestamp, event_type, user_id) GROUP BY 2)")
EXTRA["retention_tiers"] = EXTRA["retention_events"] = [ROLES, TIERS_ALL]


def _day_tiers(data_type, source, as_of, col="timestamp"):
    tier = _tier(as_of).replace("timestamp", "CAST(day AS TIMESTAMP)")
    return (f"SELECT '{data_type}' AS data_type, {tier} AS tier, sum(n) AS n, count(day) AS d "
            f"FROM (SELECT CAST({col} AS DATE) AS day, count(*) AS n FROM {source} GROUP BY 1) GROUP BY 2")


SQL["retention_move"] = "SELECT data_type, tier, CAST(n AS BIGINT) AS record_count, d AS n_days FROM (" \
    + " UNION ALL ".join([
        _day_tiers("audit", "audit", AS_OF_EVENTS), _day_tiers("transaction", "transactions", AS_OF_ORDERS),
        _day_tiers("escalation", "escalations", AS_OF_EVENTS, "created_at"),
        _day_tiers("compliance", "(" + "\nUNION ALL\n".join(UNIFIED_PARTS[1:])
                   + ") x(source, framework, event_id, timestamp, event_type, user_id)", AS_OF_EVENTS)]) \
    + ") t WHERE tier <> 'expired'"
EXTRA["retention_move"] = [ROLES]

SQL["unverified_access"] = """
SELECT a.* FROM audit a LEFT JOIN (
  SELECT user_id, min(timestamp) AS login FROM audit WHERE event_type = 'auth_success' AND success
  GROUP BY user_id) l ON l.user_id = a.user_id
WHERE a.event_type IN ('account_access', 'transaction_query') AND a.success
  AND (l.login IS NULL OR l.login > a.timestamp)"""


SQL["top_tools"] = f"""
SELECT tool, count(*) AS n FROM (SELECT {ACTION_TOOL} AS tool FROM audit) x WHERE tool IS NOT NULL
GROUP BY tool ORDER BY n DESC, tool LIMIT 10"""

OFFERED = """offered AS (
  SELECT concat('sup', CAST(s_suppkey AS VARCHAR)) AS account_id, concat('u', CAST(s_suppkey AS VARCHAR)) AS user_id,
         'checking' AS account_type, CAST(s_acctbal AS DECIMAL(18, 2)) AS balance, 'USD' AS currency,
         'active' AS status FROM supplier
  UNION ALL SELECT account_id, user_id, account_type, balance, currency, status FROM accounts)"""


def _append(batch, key, order, existing, parent=None):
    gone = f"WHEN p.user_id IS NULL THEN 'missing_{parent}'" if parent else ""
    return f"""
SELECT b.* EXCLUDE (rn), CASE WHEN e.k IS NOT NULL THEN 'duplicate_key' WHEN b.rn > 1 THEN 'duplicate_in_batch'
       {gone} ELSE 'accepted' END AS append_status
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({batch}) x) b
LEFT JOIN (SELECT DISTINCT {key} AS k FROM {existing}) e ON e.k = b.{key}
LEFT JOIN (SELECT DISTINCT user_id FROM users) p ON p.user_id = b.user_id"""


SQL["bulk_append_accounts"] = _append("SELECT * FROM offered", "account_id", "user_id, balance", "accounts", "user_id")
EXTRA["bulk_append_accounts"] = [OFFERED]
SQL["bulk_append_users"] = _append(
    "SELECT user_id, concat('User ', user_id) AS name, concat(user_id, '@example.com') AS email, 'user' AS role_raw "
    "FROM offered", "user_id", "email", "users")
EXTRA["bulk_append_users"] = [OFFERED]
SQL["bulk_append_tickets"] = _append(
    f"SELECT id, user_id, input_text, created_at, status FROM ({SQL['fraud_tickets']}) f "
    "UNION ALL SELECT id, user_id, input_text, created_at, status FROM escalations",
    "id", "created_at, user_id", "escalations", "user_id")

SQL["weekly_costs"] = f"""
SELECT week, section, item, cost, n_events, round(CAST(cost AS DOUBLE) / n_events, 8) AS cost_per_event,
       round(CASE WHEN of_week = 0 THEN NULL ELSE CAST(cost AS DOUBLE) / CAST(of_week AS DOUBLE) END, 6) AS share,
       prev_cost, round(CASE WHEN prev_cost = 0 THEN NULL ELSE
         (CAST(cost AS DOUBLE) - CAST(prev_cost AS DOUBLE)) * 100 / CAST(prev_cost AS DOUBLE) END, 4) AS change_pct
FROM (SELECT week, section, item, cost, n_events,
             sum(cost) OVER (PARTITION BY week, section) AS of_week,
             lag(cost) OVER (PARTITION BY section, item ORDER BY week) AS prev_cost
      FROM (SELECT week, 'total' AS section, 'all' AS item, sum(cost) AS cost, count(*) AS n_events
            FROM spent GROUP BY ALL
            UNION ALL SELECT week, 'tool', tool, sum(cost), count(*) FROM spent GROUP BY ALL
            UNION ALL SELECT week, 'model', model, sum(cost), count(*) FROM spent GROUP BY ALL) g) w"""
EXTRA["weekly_costs"] = [f"""spent AS (
  SELECT CAST(date_trunc('week', timestamp) AS TIMESTAMP) AS week, {TOOLX} AS tool, {MODELX} AS model,
         {COSTX} AS cost FROM audit)"""]

SQL["tool_counts_by_role"] = f"""
SELECT v.role, v.n AS tools_visible, (SELECT count(*) FROM roles r WHERE r.role = v.role) AS users,
       count(e.call_id) AS calls, count(e.call_id) FILTER (WHERE e.entitled) AS entitled_calls,
       count(e.call_id) FILTER (WHERE NOT e.entitled) AS denied_calls, count(DISTINCT e.tool) AS tools_called
FROM (SELECT role, count(*) AS n FROM role_tool GROUP BY role) v
LEFT JOIN ({SQL['tool_call_entitlement']}) e ON e.role = v.role GROUP BY v.role, v.n"""
EXTRA["tool_counts_by_role"] = EXTRA["tool_call_entitlement"]

SQL["brute_force_retries"] = SQL["brute_force"].replace("FROM audit WHERE event_type = 'auth_failure'", """
   FROM (SELECT event_id, user_id, timestamp + to_minutes(15 * k) AS timestamp
         FROM audit, range(0, 5) r(k) WHERE event_type = 'auth_failure' AND k <= event_id % 5) t""")
SQL["exfiltration_p90"] = SQL["exfiltration"].replace("0.99", "0.9")
SQL["unlogged_access_gaps"] = """
SELECT * FROM audit WHERE event_type IN ('account_access', 'transaction_query')
  AND (NOT success OR event_id % 7 = 0 OR event_id % 11 = 0)"""

_STEM = ("concat_ws('-', 'transfer', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), from_account_id, "
         "to_account_id, CAST(amount AS VARCHAR), CAST(requested_at AS VARCHAR))")
SQL["transfer_leg_faults"] = SQL["transfer_leg_match"].replace("FROM legs", "FROM faulty")
EXTRA["transfer_leg_faults"] = [f"""faulty AS (
  SELECT concat({_STEM}, '_from') AS transaction_id, -amount AS amount FROM transfer_requests
  UNION ALL
  SELECT concat({_STEM}, '_to'), CASE WHEN l_orderkey % 9 = 0 THEN amount - 0.01 ELSE amount END
  FROM transfer_requests, range(0, 2) r(k)
  WHERE k < CASE WHEN l_orderkey % 5 = 0 THEN 0 WHEN l_orderkey % 7 = 0 THEN 2 ELSE 1 END)"""]


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v, *EXTRA.get(k, [])) for k, v in SQL.items()}
