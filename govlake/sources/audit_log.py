"""Audit and compliance logs as JSON lines (SRC-1, SRC-2, SRC-3).

Lines are read as text and parsed with ``try_parse_json`` into VARIANT, not
with the JSON reader and a schema: a line whose ``success`` has the wrong type
would become a corrupt record there, while the reference keeps it.  Blank
and unparsable lines, and JSON values that are not objects, are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMEWORK_PREFIXES = [("pci_dss_", "pci_dss"), ("soc2_", "soc2"), ("compliance_", "general")]


def _get(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def truthy(v: Column, missing: bool = True) -> Column:
    """Python truthiness of a JSON value; a missing key gives ``missing``."""
    kind = F.schema_of_variant(v)
    as_text = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull(), F.lit(missing))
            .when(F.is_variant_null(v), F.lit(False))
            .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(kind == "STRING", F.char_length(as_text) > 0)
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"),
                  ~F.to_json(v).isin("{}", "[]"))
            .otherwise(F.try_variant_get(v, "$", "double") != 0))


def parse_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse JSON lines into typed audit columns plus ``details`` (VARIANT)."""
    v = F.try_parse_json(F.col(text_col))
    parsed = lines.withColumn("_v", v).filter(
        F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT"))
    return parsed.select(*[c for c in lines.columns if c != text_col],
                         *[c.alias(n) for n, c in _event_fields(F.col("_v")).items()])


def _event_fields(ev: Column) -> dict[str, Column]:
    """The typed columns of a parsed line."""
    return {"timestamp": _get(ev, "$.timestamp").try_cast("timestamp_ntz"),
            "event_type": _get(ev, "$.event_type"), "user_id": _get(ev, "$.user_id"),
            "action": _get(ev, "$.action"),
            "success": truthy(F.variant_get(ev, "$.success", "variant")),
            "details": F.variant_get(ev, "$.details", "variant"),
            "session_id": _get(ev, "$.session_id"), "error": _get(ev, "$.error")}


def _kind(text_col: str) -> Column:
    v = F.try_parse_json(F.col(text_col))
    return F.when(F.trim(F.coalesce(text_col, F.lit(""))) == "", "blank").when(v.isNull(), "not_json") \
        .when(F.schema_of_variant(v).startswith("OBJECT"), "kept").otherwise("not_object")


KINDS = ("kept", "blank", "not_json", "not_object")


def ingest_log(spark: SparkSession, path: str, out: str) -> str:
    """SRC-1 with its drop counts in one pass over the log: every line goes to
    the Parquet folder of its kind under ``out``, the kept ones as typed events
    (details as JSON text), the dropped ones as they are."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    kept = F.col("kind") == "kept"
    events = _event_fields(F.col("_v"))
    events["details"] = F.to_json(events["details"])
    events["event_date"] = F.to_date(events["timestamp"])
    lines.select(_kind("value").alias("kind"), "value", F.try_parse_json("value").alias("_v")).select(
        "kind", F.when(~kept, F.col("value")).alias("dropped_line"),
        *[F.when(kept, c).alias(n) for n, c in events.items()]) \
        .write.mode("overwrite").partitionBy("kind").parquet(out)
    return out


def ingested_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).filter(F.col("kind") == "kept").drop("kind", "dropped_line")


def dropped_lines(spark: SparkSession, out: str) -> DataFrame:
    """The lines an ingest left out, with their kind."""
    return spark.read.parquet(out).filter(F.col("kind") != "kept").select("kind", "dropped_line")


def ingest_counts(spark: SparkSession, out: str) -> DataFrame:
    """One row: n_lines and the lines of each kind, from the stored folders
    (only their row counts are read, no line and no column)."""
    kinds = spark.read.parquet(out).select("kind")
    return kinds.agg(F.count("*").alias("n_lines"),
                     *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])


def line_counts(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per source column value (or one in all): how many lines were
    read, kept by ``parse_lines``, blank, not JSON, and JSON but no object."""
    return lines.withColumn("_kind", _kind(text_col)).groupBy(*[c for c in lines.columns if c != text_col]).agg(
        F.count("*").alias("n_lines"),
        *[F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in KINDS])


def read_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1's count of dropped lines, per file under ``path``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path) \
        .withColumn("file", F.col("_metadata.file_path"))
    return line_counts(lines)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: every JSON line under ``path`` (recursively), with the day of the
    event as ``event_date``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_lines(lines).withColumn("event_date", F.to_date("timestamp"))


def log_days(spark: SparkSession, path: str) -> list[str]:
    """The days a log written by SNK-1 holds, oldest first, from its folder
    names (one per day); no file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    days = [n.removeprefix("event_date=") for n in names if n.startswith("event_date=")]
    return sorted(d for d in days if d != "__HIVE_DEFAULT_PARTITION__")


def read_audit_day(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """SRC-3 on a log written by SNK-1: the events of one day, by default of
    the newest one.  The day is a literal partition filter, so only its folder
    is read; a log without that day gives no rows."""
    days = log_days(spark, path)
    if day is None:
        day = days[-1] if days else None
    lines = spark.read.schema("value string, event_date date").text(path) if days \
        else spark.createDataFrame([], "value string, event_date date")
    return parse_lines(lines.filter(F.col("event_date") == F.lit(day).cast("date")))


def read_compliance(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: compliance records with their framework.

    The framework comes from a ``framework=`` folder (our writer) or from the
    file name prefix pci_dss_, soc2_, compliance_ (the reference's files)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path) \
        .withColumn("_path", F.col("_metadata.file_path"))
    name = F.element_at(F.split(F.col("_path"), "/"), -1)
    fw = F.nullif(F.regexp_extract(F.col("_path"), "framework=([^/]+)", 1), F.lit(""))
    by_name = F.lit(None).cast("string")
    for prefix, fw_name in reversed(FRAMEWORK_PREFIXES):
        by_name = F.when(name.startswith(prefix), F.lit(fw_name)).otherwise(by_name)
    lines = lines.withColumn("framework", F.coalesce(fw, by_name)) \
        .filter(F.col("framework").isNotNull()).drop("_path")
    return parse_lines(lines).withColumn("event_date", F.to_date("timestamp"))


def by_date(events: DataFrame, date=None) -> DataFrame:
    """SRC-3: events of one day; by default the newest day present.

    With a literal date the filter prunes partitions; the default compares
    with a scalar subquery on max(event_date) (on a partitioned table its
    value also prunes partitions at run time)."""
    d = F.to_date("timestamp") if "event_date" not in events.columns else F.col("event_date")
    if date is not None:
        return events.filter(d == F.lit(date).cast("date"))
    return events.filter(d == events.select(F.max(d)).scalar())
