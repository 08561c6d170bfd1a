"""Structured Streaming forms of the log follower, rates, sessions, alerts,
de-duplication, the transfer fold and the ticket table (STR-1 .. STR-11).

Each stream reads new files of JSON lines from a folder (writers must move
finished files in; the file source does not see growing files), keeps its
progress in a checkpoint folder, and writes to a sink that survives restarts.
``run_available_now`` drives a stream over what is there and stops, which is
how tests and batch back-fills use them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts as AL
from ..sources.audit_log import parse_lines

WATERMARK = "10 minutes"


def follow(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """STR-1: every new audit line under ``path`` as parsed events.

    The event time is cast to TIMESTAMP for watermarks."""
    r = spark.readStream.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = r.text(path)
    return parse_lines(lines).withColumn("event_time", F.col("timestamp").cast("timestamp")) \
        .withColumn("event_date", F.to_date("timestamp"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append",
                      state_store: str | None = None) -> str:
    """Process everything available, then stop; the sink is a folder.

    ``state_store`` names a state store provider for this query only (the
    session setting is restored once the query has started; the provider is
    recorded in the query's checkpoint)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark = df.sparkSession
    before = spark.conf.get(key, None)
    if state_store:
        spark.conf.set(key, state_store)
    try:
        q = (df.writeStream.format(fmt).outputMode(output_mode)
             .option("checkpointLocation", checkpoint).option("path", out_path)
             .trigger(availableNow=True).start())
    finally:
        if state_store:
            if before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out_path


def newest(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of every key that ``run_snapshots`` wrote."""
    rest = [c for c in snapshots.columns if c not in (*keys, "batch_id")]
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v")) \
        .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def rate(events: DataFrame, duration: str = "1 minute", slide: str | None = None) -> DataFrame:
    """STR-2: events per tumbling or (with ``slide``) sliding window with a
    watermark.  In append mode closed windows only; ``run_snapshots`` drives it
    in update mode, where open windows are shown too."""
    w = F.window("event_time", duration, slide) if slide else F.window("event_time", duration)
    return events.withWatermark("event_time", WATERMARK).groupBy(w.alias("w")) \
        .agg(F.count("*").alias("n")) \
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n")


def sessions(events: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """STR-3: closed gap sessions per user."""
    return events.withWatermark("event_time", WATERMARK) \
        .groupBy("user_id", F.session_window("event_time", f"{gap_minutes} minutes").alias("s")) \
        .agg(F.count("*").alias("interactions"),
             F.min("event_time").cast("timestamp_ntz").alias("start_time"),
             F.max("event_time").cast("timestamp_ntz").alias("end_time"),
             F.count_if(F.col("event_type") == "safety_block").alias("safety_blocks")) \
        .drop("s")


def alert_windows(events: DataFrame, duration: str = "1 hour") -> DataFrame:
    """STR-5, STR-6, STR-7 on a stream: per window (closed ones in append mode,
    open ones too with ``run_snapshots``), error rate, block
    rate and approximate p95 latency with their levels."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    lat = F.try_variant_get(F.col("details"), "$.latency_ms", "double")
    g = events.withWatermark("event_time", WATERMARK).groupBy(F.window("event_time", duration)
                                                              .alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(~ok).alias("errors"),
        F.count_if(F.col("event_type") == "safety_block").alias("blocks"),
        F.count_if(F.col("action") == "fraud_report").alias("fraud_reports"),
        F.percentile_approx(lat, 0.95, 10000).alias("p95_ms"))
    err = F.round(F.try_divide(F.col("errors").cast("double"), F.col("requests")), 6)
    blk = F.round(F.try_divide(F.col("blocks").cast("double"), F.col("requests")), 6)
    return g.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "errors",
        err.alias("error_rate"),
        F.when(err > AL.ERROR_CRIT, "critical").when(err > AL.ERROR_WARN, "warning")
        .otherwise("ok").alias("error_level"),
        "blocks", blk.alias("block_rate"),
        F.when(blk > AL.BLOCK_WARN, "warning").otherwise("ok").alias("block_level"),
        "fraud_reports", (F.col("fraud_reports") > AL.FRAUD_SPIKE_MIN).alias("fraud_alert"),
        "p95_ms", (F.col("p95_ms") > AL.LATENCY_P95_MS).alias("latency_alert"))


def backlog_stream(ticket_events: DataFrame) -> DataFrame:
    """STR-8 on a stream: pending count as a running global aggregate of
    +1 / -1 events (update mode; the state is one number)."""
    return ticket_events.agg(F.sum("delta").alias("pending"),
                             F.max("ts").alias("as_of")) \
        .withColumn("alert", F.col("pending") > AL.BACKLOG_MAX)


def run_snapshots(df: DataFrame, out_path: str, checkpoint: str) -> str:
    """Drive an update-mode aggregate over what is available; every
    micro-batch appends its changed rows with the batch id, so the newest
    value of a key is the row of the largest batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)
    q = (df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out_path


def dedup(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """STR-9: drop repeated lines (same text) within the watermark delay."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["line_hash"])


def bucket_of_key(key: str, buckets: int) -> Column:
    """The bucket of a key in a stateful operator that holds many keys per state row."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


# --- STR-10: transfers as a stateful service ----------------------------------

#: Buckets of owners; fixed for the life of a checkpoint.
OWNER_BUCKETS = 1024

TRANSFER_OUT = ("l_orderkey long, l_linenumber int, requester_id string, "
                "from_account_id string, to_account_id string, amount_cents long, "
                "status string, src_cents_after long, dst_cents_after long")


class TransferFold(StatefulProcessor):
    """Balances (cents) of the accounts of a bucket of owners as parallel arrays,
    loaded from the accounts before the first request; an owner's balances are its
    own.  The requests of a micro-batch are applied in request order, micro-batches
    as they come; chunks of a batch are read one by one into plain tuples, so a task
    holds one bucket's requests of one micro-batch (bounded by the source's files
    per trigger) and makes a few state calls for them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balances = handle.getValueState("balances", "owners array<string>, accounts array<string>, "
                                             "cents array<long>")

    def _held(self) -> dict[tuple, int]:
        owners, accounts, cents = self.balances.get() if self.balances.exists() else ([], [], [])
        return dict(zip(zip(owners, accounts), cents))

    def _hold(self, held: dict[tuple, int]) -> None:
        self.balances.update(([o for o, _ in held], [a for _, a in held], list(held.values())))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held = self._held()
        held.update(zip(zip(initialState["requester_id"].tolist(), initialState["account_id"].tolist()),
                        initialState["cents"].tolist()))
        self._hold(held)

    def handleInputRows(self, key, rows, timerValues):
        cols = ["l_orderkey", "l_linenumber", "from_account_id", "to_account_id", "amount_cents", "requester_id"]
        # times as integers: quick to compare, a missing one is the smallest
        requests = sorted(r for chunk in rows for r in zip(chunk["requested_at"].to_numpy().astype("int64").tolist(),
                                                           *(chunk[c].tolist() for c in cols)))
        if not requests:
            return
        held = self._held()
        out = []
        for _, order, line, source, target, cents, owner in requests:
            s, d = held.get((owner, source), 0), held.get((owner, target), 0)
            status = "accepted" if s >= cents else "insufficient_funds"
            if s >= cents:
                s, d = s - cents, d + cents
            held[owner, source], held[owner, target] = s, d
            out.append((order, line, owner, source, target, cents, status, s, d))
        self._hold(held)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in TRANSFER_OUT.split(", ")])

    def close(self) -> None:
        pass


def _money(cents: str) -> Column:
    return (F.col(cents).cast("decimal(20,0)") / 100).cast("decimal(18,2)")


def transfers(candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """STR-10: the transfer fold of LED-4 keyed by buckets of owners.  ``accounts``
    (account_id, user_id, balance) are the initial state; from then on the
    RocksDB state store keeps the balances between micro-batches."""
    def by_bucket(df: DataFrame):
        return df.withColumn("bucket", bucket_of_key("requester_id", OWNER_BUCKETS)).groupBy("bucket")

    opening = accounts.select(F.col("user_id").alias("requester_id"), "account_id",
                              F.coalesce((F.col("balance") * 100).cast("bigint"), F.lit(0)).alias("cents"))
    requests = candidates.select("l_orderkey", "l_linenumber", "requested_at", "requester_id", "from_account_id",
                                 "to_account_id", (F.col("amount") * 100).cast("bigint").alias("amount_cents"))
    return by_bucket(requests).transformWithStateInPandas(
        TransferFold(), TRANSFER_OUT, "Append", "None", initialState=by_bucket(opening)).select(
        "l_orderkey", "l_linenumber", "requester_id", "from_account_id", "to_account_id",
        _money("amount_cents").alias("amount"), "status", _money("src_cents_after").alias("src_balance_after"),
        _money("dst_cents_after").alias("dst_balance_after"))


def balances_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The balances a transfer stream holds, read from its state store."""
    state = spark.read.format("statestore").option("stateVarName", "balances").load(checkpoint)
    return state.select(F.explode(F.arrays_zip("value.owners", "value.accounts", "value.cents")).alias("b")).select(
        F.col("b.owners").alias("user_id"), F.col("b.accounts").alias("account_id"), _money("b.cents").alias("balance"))


# --- STR-11: the ticket table kept current from events -------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Buckets of ids in the ticket index and among waiting resolutions.
TICKET_BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(TICKET_BUCKETS)).cast("int")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _values(df: DataFrame, col: str) -> list:
    """The distinct values of a column with a fixed number of them (buckets, days)."""
    return sorted(df.agg(F.collect_set(col)).first()[0])


def waiting_resolutions(spark: SparkSession, table_path: str) -> DataFrame:
    """Resolutions whose ticket has not come yet: id, r_at, r_by, r_seq."""
    path = f"{table_path.rstrip('/')}_waiting"
    schema = "id string, r_at timestamp_ntz, r_by string, r_seq bigint, bucket int"
    found = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    return found.filter(F.col("id").isNotNull())


def merge_ticket_batch(table_path: str):
    """foreachBatch function: apply create and resolve events of one batch to
    the ticket table (Parquet partitioned by created day).

    Beside the table stand an index (id -> created day) and the resolutions
    that came before their ticket, both in TICKET_BUCKETS folders of ids.  A
    batch reads the index and waiting buckets of its own ids, then only the
    days those tickets lie in (literal partition filters), and rewrites those
    folders (dynamic partition overwrite).  The table keeps the time and order
    of the resolution that counts, so events may come in any order and any
    split into batches.  The table is replaced first, then the index, then what
    waits; each step gives the same result when a batch is replayed.  Staged
    rows are removed at the end."""
    base = table_path.rstrip("/")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        stage = f"{base}_staging/batch={batch_id}"
        creates = batch.filter(F.col("kind") == "create").select(
            "id", "user_id", "input_text", "agent_reasoning", "confidence", "created_at",
            F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
            F.lit(None).cast("bigint").alias("resolved_seq"),
            F.lit(None).cast("string").alias("resolved_by"),
            F.to_date("created_at").alias("created_day"))
        resolves = batch.filter(F.col("kind") == "resolve").select(
            "id", F.col("event_time_ntz").alias("r_at"), F.col("actor").alias("r_by"),
            F.col("seq").alias("r_seq"))
        buckets = _values(batch.select(_bucket().alias("bucket")), "bucket")
        resolves = resolves.unionByName(waiting_resolutions(spark, base).filter(F.col("bucket").isin(buckets))
                                        .drop("bucket")).distinct()
        index = f"{base}_index"
        known = spark.read.schema("id string, created_day date, bucket int").parquet(index) \
            if _exists(spark, index) else spark.createDataFrame([], "id string, created_day date, bucket int")
        known = known.filter(F.col("bucket").isin(buckets)).select("id", "created_day")
        days = _values(known.join(batch.select("id").distinct(), "id", "left_semi").select("created_day")
                       .unionByName(creates.select("created_day")), "created_day")
        # only a missing table is an empty one; any other read error fails the batch
        current = spark.read.schema(creates.schema).parquet(base) if _exists(spark, base) else creates.limit(0)
        current = current.filter(F.col("created_day").isin(days))
        # a create for a ticket already in the table is a replayed batch: keep
        # the table's row
        touched = current.unionByName(creates.join(current.select("id"), "id", "left_anti"))
        # the latest resolution wins (time, then event order), as in ESC-3,
        # also against one of an earlier batch
        last = resolves.groupBy("id").agg(F.max(F.struct(
            F.col("r_at").alias("at"), F.col("r_seq").alias("seq"), F.col("r_by").alias("by"))).alias("r"))
        old = F.when(F.col("resolved_at").isNotNull(), F.struct(
            F.col("resolved_at").alias("at"), F.col("resolved_seq").alias("seq"),
            F.col("resolved_by").alias("by")))
        merged = touched.join(last, "id", "left").withColumn("r", F.greatest(F.col("r"), old)).select(
            "id", "user_id", "input_text", "agent_reasoning", "confidence", "created_at",
            F.when(F.col("r").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"),
            F.col("r.at").alias("resolved_at"), F.col("r.seq").alias("resolved_seq"),
            F.col("r.by").alias("resolved_by"), "created_day")
        entries = known.unionByName(creates.select("id", "created_day")).distinct()
        waits = resolves.join(entries.select("id").distinct(), "id", "left_anti")
        # a row without an id keeps the folder of a bucket that has none left
        empty = batch.select(_bucket().alias("bucket")).distinct().select(
            F.lit(None).cast("string").alias("id"), F.lit(None).cast("timestamp_ntz").alias("r_at"),
            F.lit(None).cast("string").alias("r_by"), F.lit(None).cast("bigint").alias("r_seq"), "bucket")
        # the folders replaced below are inputs of this batch: stage first
        staged = [(base, "created_day", merged),
                  (index, "bucket", entries.withColumn("bucket", _bucket())),
                  (f"{base}_waiting", "bucket", waits.withColumn("bucket", _bucket()).unionByName(empty))]
        for n, (_, _, rows) in enumerate(staged):
            rows.write.mode("overwrite").parquet(f"{stage}/{n}")
        for n, (path, by, rows) in enumerate(staged):
            spark.read.schema(rows.schema).parquet(f"{stage}/{n}").write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        _remove(spark, stage)
        batch.unpersist()
    return apply
