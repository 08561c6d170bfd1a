"""Compliance records from the audit log (CMP-1 .. CMP-8).

Each record has the reference's shape (framework, event_type, user_id and the
detail fields as columns) and keeps ``event_id`` of the audit event it came
from, so unlogged access (CMP-7) is a left-anti join on that key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ_EVENTS = ["account_access", "transaction_query"]
AUTH_EVENTS = ["auth_success", "auth_failure"]


def _record(df: DataFrame, framework: str, event_type: str, **details) -> DataFrame:
    return df.select("event_id", "timestamp", F.lit(framework).alias("framework"),
                     F.lit(event_type).alias("event_type"), "user_id",
                     *[v.alias(k) for k, v in details.items()])


def _data_type():
    return F.when(F.col("event_type") == "account_access", "account").otherwise("transaction")


def _operation():
    return F.when(F.col("action").contains("transfer"), "transfer").otherwise("read")


def pci_data_access(audit: DataFrame) -> DataFrame:
    """CMP-1: successful account and transaction reads and transfers become
    PCI-DSS 10.2 records."""
    ev = audit.filter(F.col("event_type").isin(*READ_EVENTS) & F.col("success"))
    return _record(ev, "pci_dss", "pci_data_access", data_type=_data_type(),
                   account_id=F.col("account_id"), operation=_operation(),
                   requirement=F.lit("PCI-DSS 10.2"))


def pci_authentication(audit: DataFrame) -> DataFrame:
    """CMP-2: authentication events become PCI-DSS 10.2.4 records."""
    ev = audit.filter(F.col("event_type").isin(*AUTH_EVENTS))
    return _record(ev, "pci_dss", "pci_authentication", success=F.col("success"),
                   method=F.col("action"), ip_address=F.lit(None).cast("string"),
                   requirement=F.lit("PCI-DSS 10.2.4"))


def pci_privileged_action(audit: DataFrame, roles: DataFrame) -> DataFrame:
    """CMP-3: every action of a staff or admin user becomes a PCI-DSS 10.2.2
    record."""
    priv = roles.filter(F.col("role").isin("staff", "admin", "system")).select("user_id")
    ev = audit.join(priv, "user_id", "left_semi")
    return _record(ev, "pci_dss", "pci_privileged_action", action=F.col("action"),
                   target=F.col("account_id"),
                   result=F.when(F.col("success"), "success").otherwise("failure"),
                   requirement=F.lit("PCI-DSS 10.2.2"))


def soc2_access_control(decisions: DataFrame) -> DataFrame:
    """CMP-4: every access decision (IAM-2 output) becomes a SOC2 CC6.1
    record.  ``decisions`` carry request_id (the audit event), timestamp,
    user_id, resource, permission, granted."""
    d = decisions.withColumnRenamed("request_id", "event_id")
    return _record(d, "soc2", "soc2_access_control", resource=F.col("resource"),
                   permission=F.col("permission"), granted=F.col("granted"),
                   control=F.lit("SOC2 CC6.1"))


def soc2_data_processing(audit: DataFrame) -> DataFrame:
    """CMP-5: data operations become SOC2 CC6.7 records."""
    ev = audit.filter(F.col("event_type").isin(*READ_EVENTS))
    return _record(ev, "soc2", "soc2_data_processing", data_type=_data_type(),
                   operation=_operation(), purpose=F.lit("customer_service"),
                   control=F.lit("SOC2 CC6.7"))


def soc2_incidents(audit: DataFrame) -> DataFrame:
    """CMP-6: fraud reports become CC7.3 incidents of severity high."""
    ev = audit.filter(F.col("action") == "fraud_report")
    desc = F.coalesce(F.col("description"), F.lit("")) if "description" in audit.columns \
        else F.lit("")
    return _record(ev, "soc2", "soc2_incident", incident_type=F.lit("fraud_report"),
                   severity=F.lit("high"),
                   description=F.concat(F.lit("Account "), F.col("account_id"), F.lit(": "),
                                        F.left(desc, F.lit(200))),
                   control=F.lit("SOC2 CC7.3"))


def unlogged_access(audit: DataFrame, records: DataFrame) -> DataFrame:
    """CMP-7: account or transaction reads without a PCI record (COMP-003)."""
    reads = audit.filter(F.col("event_type").isin(*READ_EVENTS))
    pci = records.filter(F.col("event_type") == "pci_data_access").select("event_id")
    return reads.join(pci, "event_id", "left_anti")


def unverified_access(audit: DataFrame) -> DataFrame:
    """COMP-002: successful account or transaction reads of a user without a
    successful login at or before the read (a null user has never logged in)."""
    logins = audit.filter((F.col("event_type") == "auth_success") & F.col("success")) \
        .groupBy("user_id").agg(F.min("timestamp").alias("_login"))
    reads = audit.filter(F.col("event_type").isin(*READ_EVENTS) & F.col("success"))
    return reads.join(logins, "user_id", "left") \
        .filter(F.coalesce(F.col("_login") > F.col("timestamp"), F.lit(True))) \
        .select(*audit.columns)


def unified_event_log(audit: DataFrame, records: list[DataFrame]) -> DataFrame:
    """CMP-8: audit events and compliance records in one frame (any records,
    each with its own detail columns)."""
    out = audit.withColumn("source", F.lit("audit"))
    for r in records:
        out = out.unionByName(r.withColumn("source", F.lit("compliance")),
                              allowMissingColumns=True)
    return out


def record_kinds(roles: DataFrame, permission_of_type: dict[str, str]):
    """The record each audit event produces, as (framework, event_type,
    condition) triples; the same conditions as CMP-1 .. CMP-6."""
    e, a = F.col("event_type"), F.coalesce(F.col("action"), F.lit(""))
    perm = F.create_map(*[x for k, v in permission_of_type.items() for x in (F.lit(k), F.lit(v))])
    return [
        ("pci_dss", "pci_data_access", e.isin(*READ_EVENTS) & F.col("success")),
        ("pci_dss", "pci_authentication", e.isin(*AUTH_EVENTS)),
        ("pci_dss", "pci_privileged_action", F.col("_privileged")),
        ("soc2", "soc2_access_control", perm[e].isNotNull()),
        ("soc2", "soc2_data_processing", e.isin(*READ_EVENTS)),
        ("soc2", "soc2_incident", a == "fraud_report"),
    ]


def unified_event_log_one_pass(audit: DataFrame, roles: DataFrame,
                               permission_of_type: dict[str, str]) -> DataFrame:
    """CMP-8 in one pass: every audit event and the compliance records it
    produces (source, framework, event_id, timestamp, event_type, user_id).
    One scan of the log and one join with the roles, instead of one scan per
    record kind."""
    priv = roles.filter(F.col("role").isin("staff", "admin", "system")) \
        .select("user_id", F.lit(True).alias("_privileged"))
    ev = audit.join(priv, "user_id", "left") \
        .withColumn("_privileged", F.coalesce("_privileged", F.lit(False)))
    items = [F.struct(F.lit("audit").alias("source"), F.lit("audit").alias("framework"),
                      F.col("event_type").alias("kind"))]
    for fw, kind, cond in record_kinds(roles, permission_of_type):
        items.append(F.when(cond, F.struct(F.lit("compliance").alias("source"),
                                           F.lit(fw).alias("framework"),
                                           F.lit(kind).alias("kind"))))
    return ev.select("event_id", "timestamp", "user_id", F.explode(F.array(*items)).alias("r")) \
        .filter(F.col("r").isNotNull()).select(
            "r.source", "r.framework", "event_id", "timestamp",
            F.col("r.kind").alias("event_type"), "user_id")
