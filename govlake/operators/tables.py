"""Table maintenance in bulk (SNK-3 .. SNK-7, WIN-2).

The reference writes one row per call into SQLite, which enforces keys,
UNIQUE and NOT NULL.  Here a whole batch is checked against the table with
joins and aggregations, and retention is computed per row age.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ts_ntz

from .. import schemas as S
from ..functions.joins import join_null_safe


REPEAT_CHUNK = 1024


def repeat_rows(df: DataFrame, count_col: str) -> DataFrame:
    """Each row ``count_col`` times, in chunks of at most 1024 copies per
    generated array, so a very large count never builds one huge array."""
    c = F.col(count_col)
    chunks = df.filter(c > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                       F.floor((c - 1) / REPEAT_CHUNK).cast("bigint"))))
    k = F.least(F.lit(REPEAT_CHUNK).cast("bigint"), c - F.col("_chunk") * REPEAT_CHUNK)
    return chunks.withColumn("_x", F.explode(F.array_repeat(F.lit(0), k.cast("int")))) \
        .drop("_chunk", "_x")


def bulk_append(existing: DataFrame, batch: DataFrame, key: str, order_cols: list[str],
                foreign_keys: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """SNK-3: status of every batch row: accepted, duplicate_key (key already
    in the table), duplicate_in_batch (a later copy of a key in the batch),
    null_key (every row without a key) or
    missing_<col> (foreign key without a parent).

    The batch is written once to the checkpoint folder (it is read several
    times below, and its lineage may be long).  Only hashes of the keys are
    counted over the whole batch and table: a row whose hash no other row and
    no table key has is the only one of a new key (``_doubtful``).  The other
    rows are looked up by the keys themselves: counts and table keys on a narrow
    frame of one row per key, which the rows' own columns meet in one join.
    Only the copies of a new key that the batch holds more than once are ordered
    (``_first_copies``), and rows without a key are joined with nothing."""
    from ..session import materialize
    cols = batch.columns
    batch = materialize(batch, "append-batch")
    absent = [(c, materialize(_absent(batch, c, parent, parent_col), "append-absent"))
              for c, parent, parent_col in foreign_keys]
    codes, code = _doubtful(existing, batch, key)
    codes = materialize(codes, "append-codes")
    keyed = batch.filter(F.col(key).isNotNull()).withColumn("_code", code)
    clear = keyed.join(codes, "_code", "left_anti").select(*cols)
    batch_rest = keyed.join(codes, "_code", "left_semi").select(*cols)
    known = existing.select(key).withColumn("_code", code).join(codes, "_code", "left_semi").select(key).distinct()

    # a key with one row has one parent value, so any of an aggregate's will do
    parents = dict.fromkeys(c for c, _ in absent if c != key)
    keys = batch_rest.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in parents])
    keys = keys.join(known.withColumn("_dup", F.lit(True)), key, "left")
    plain = keys.filter((F.col("_n") == 1) | F.col("_dup").isNotNull())
    plain = _with_parents(plain, absent, F.when(F.col("_dup").isNotNull(), "duplicate_key")).select(key, "append_status")
    repeated = keys.filter((F.col("_n") > 1) & F.col("_dup").isNull()).select(key)
    return _with_parents(clear, absent).select(*cols, "append_status") \
        .unionByName(batch_rest.join(plain, key).select(*cols, "append_status")) \
        .unionByName(_first_copies(batch_rest.join(repeated, key, "left_semi").select(*cols), key, order_cols, absent)) \
        .unionByName(batch.filter(F.col(key).isNull()).withColumn("append_status", F.lit("null_key")))


def _doubtful(existing: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """(the hashes ``_code`` that several rows of the batch have, or one and a
    key of the table, the hash of a key column)."""
    keys = batch.select(key, F.lit(1).alias("_n")).union(existing.select(key, F.lit(0))) \
        .filter(F.col(key).isNotNull())
    code = F.xxhash64(F.col(key).cast(keys.schema[key].dataType))
    n = F.sum("_n")
    codes = keys.groupBy(code.alias("_code")).agg(n.alias("_n"), F.min("_n").alias("_least")) \
        .filter((F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_least") == 0)))
    return codes.select("_code"), code


def _absent(batch: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """The values of a foreign key in the batch that have no parent."""
    return batch.select(col).filter(F.col(col).isNotNull()).distinct() \
        .join(parent.select(F.col(parent_col).alias(col)), col, "left_anti")


def _with_parents(rows: DataFrame, absent: list[tuple[str, DataFrame]], lead: Column | None = None) -> DataFrame:
    """``append_status``: ``lead`` where it says something, else missing_<col>
    for the first foreign key that is null or has no parent, else accepted."""
    status = lead
    for i, (c, values) in enumerate(absent):
        rows = rows.join(values.withColumn(f"_gone{i}", F.lit(True)), c, "left")
        missing = F.col(c).isNull() | F.col(f"_gone{i}").isNotNull()
        status = (F if status is None else status).when(missing, f"missing_{c}")
    return rows.withColumn("append_status", F.lit("accepted") if status is None else status.otherwise("accepted"))


def _first_copies(batch: DataFrame, key: str, order_cols: list[str],
                  absent: list[tuple[str, DataFrame]]) -> DataFrame:
    """Status of the rows of keys that the table lacks and the batch repeats.

    The rows are reduced to distinct ones with their multiplicity (partial
    aggregation folds copies before the shuffle).  The first copy of each key is
    the minimum of (order_cols, other columns) over those rows, found by a second
    aggregation and joined back one row per key; multiplicities are expanded at
    the end in bounded chunks.  No key is sorted or buffered in one task."""
    cols = batch.columns
    g = batch.groupBy(*cols).agg(F.count("*").alias("_c"))
    order = F.struct(*[F.col(c) for c in order_cols],
                     *[F.col(c) for c in cols if c not in order_cols])
    first = g.groupBy(key).agg(F.min(order).alias("_first"))
    g = g.join(first, key).withColumn("_is_first", order.eqNullSafe(F.col("_first")))
    g = _with_parents(g, absent, F.when(~F.col("_is_first"), "duplicate_in_batch")) \
        .withColumnRenamed("append_status", "_lead")
    # one copy of a first row carries the lead status, its other copies are
    # duplicates within the batch
    parts = F.when(F.col("_is_first"), F.array(
        F.struct(F.col("_lead").alias("s"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("duplicate_in_batch").alias("s"), (F.col("_c") - 1).alias("n")))) \
        .otherwise(F.array(F.struct(F.col("_lead").alias("s"), F.col("_c").alias("n"))))
    e = g.withColumn("_p", F.explode(parts))
    e = e.select(*cols, F.col("_p.s").alias("append_status"), F.col("_p.n").alias("_n"))
    return repeat_rows(e, "_n").drop("_n")


def _stack(df: DataFrame, table: str, names: list[str]) -> DataFrame:
    """One-row frame of counts -> (table_name, check_name, n) rows."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.selectExpr(f"stack({len(names)}, {pairs}) as (check_name, n)") \
        .select(F.lit(table).alias("table_name"), "check_name", F.col("n").cast("bigint"))


def _dup_count(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).count() \
        .filter(F.col("count") > 1).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
                                        .alias("n"))


def _orphans(child: DataFrame, col: str, parent: DataFrame, pcol: str) -> DataFrame:
    return child.filter(F.col(col).isNotNull()) \
        .join(parent.select(F.col(pcol).alias(col)), col, "left_anti").agg(F.count("*").alias("n"))


def constraint_audit(users: DataFrame, accounts: DataFrame, transactions: DataFrame,
                     tickets: DataFrame) -> DataFrame:
    """SNK-4: one report (table_name, check, n) of key, UNIQUE, NOT NULL,
    foreign-key and domain breaks.  NOT NULL and domain checks are one pass
    per table; each key check is one aggregation."""
    def nn(c):
        return F.count_if(F.col(c).isNull()).alias(f"not_null_{c}")

    def dom(c, values):
        return F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias(f"domain_{c}")

    u = users.agg(nn("user_id"), nn("name"), nn("email"),
                  dom("role_raw", S.ROLES) if "role_raw" in users.columns else F.lit(0)
                  .alias("domain_role_raw"))
    a = accounts.agg(nn("account_id"), nn("user_id"), nn("account_type"), nn("balance"),
                     dom("account_type", S.ACCOUNT_TYPES))
    t = transactions.agg(nn("transaction_id"), nn("account_id"), nn("transaction_type"),
                         nn("amount"), nn("timestamp"),
                         dom("transaction_type", S.TRANSACTION_TYPES))
    k = tickets.agg(nn("id"), nn("user_id"), nn("input_text"), nn("status"),
                    dom("status", S.TICKET_STATUSES))
    parts = [
        _stack(u, "users", u.columns), _stack(a, "accounts", a.columns),
        _stack(t, "transactions", t.columns), _stack(k, "escalations", k.columns),
        _stack(_dup_count(users, "user_id").withColumnRenamed("n", "pk_user_id"), "users",
               ["pk_user_id"]),
        _stack(_dup_count(users, "email").withColumnRenamed("n", "unique_email"), "users",
               ["unique_email"]),
        _stack(_dup_count(accounts, "account_id").withColumnRenamed("n", "pk_account_id"),
               "accounts", ["pk_account_id"]),
        _stack(_dup_count(transactions, "transaction_id")
               .withColumnRenamed("n", "pk_transaction_id"), "transactions",
               ["pk_transaction_id"]),
        _stack(_dup_count(tickets, "id").withColumnRenamed("n", "pk_id"), "escalations",
               ["pk_id"]),
        _stack(_orphans(accounts, "user_id", users, "user_id").withColumnRenamed("n", "fk_user_id"),
               "accounts", ["fk_user_id"]),
        _stack(_orphans(transactions, "account_id", accounts, "account_id")
               .withColumnRenamed("n", "fk_account_id"), "transactions", ["fk_account_id"]),
        _stack(_orphans(tickets, "user_id", users, "user_id").withColumnRenamed("n", "fk_user_id"),
               "escalations", ["fk_user_id"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_state(updates: DataFrame, key: str, order_cols: list[str],
                 value_cols: list[str]) -> DataFrame:
    """WIN-2: the last update per key wins.  An aggregation with ``max_by``
    (partial aggregation before the shuffle), not a window sort per key."""
    order = F.struct(*[F.col(c) for c in order_cols])
    last = F.max_by(F.struct(*[F.col(c) for c in value_cols + order_cols]), order)
    return updates.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def account_update(accounts: DataFrame, updates: DataFrame) -> DataFrame:
    """SNK-5: set balance and status from the latest update of each account.

    ``updates``: account_id, updated_at, update_id, balance, status.  Output:
    the accounts with ``updated`` true where an update matched, plus one row
    per unmatched account id (``updated`` null, ``matched`` false)."""
    last = latest_state(updates, "account_id", ["updated_at", "update_id"],
                        ["balance", "status"]) \
        .select("account_id", F.col("balance").alias("_b"), F.col("status").alias("_s"),
                F.lit(True).alias("_hit"))
    j = accounts.join(last, "account_id", "full")
    known = F.col("user_id").isNotNull()
    hit = F.col("_hit").isNotNull()
    return j.select(
        "account_id", "user_id", "account_type",
        F.when(hit, F.col("_b")).otherwise(F.col("balance")).alias("balance"),
        "currency",
        F.when(hit, F.col("_s")).otherwise(F.col("status")).alias("status"),
        F.when(known, hit).alias("updated"), known.alias("matched"))


RETENTION_ACTIONS = {"hot": "retain", "warm": "compress", "cold": "archive",
                     "expired": "delete"}


def retention_tier(ts_col: str, as_of):
    now = ts_ntz(as_of)
    tier = None
    for name, days in S.RETENTION_DAYS:
        cond = F.col(ts_col) >= now - F.expr(f"INTERVAL {days} DAYS")
        tier = F.when(cond, name) if tier is None else tier.when(cond, name)
    return tier.otherwise("expired")


def retention_tiers(frames: dict[str, tuple[DataFrame, str, object]]) -> DataFrame:
    """SNK-6: rows per data type and tier (hot 7 days, warm 30 days, cold
    seven years, else expired), by the age of each row at its frame's
    ``as_of``.  ``frames``: data_type -> (frame, timestamp column, as_of)."""
    out = None
    for data_type, (df, ts_col, as_of) in frames.items():
        part = df.select(retention_tier(ts_col, as_of).alias("tier")).groupBy("tier") \
            .agg(F.count("*").alias("record_count")) \
            .select(F.lit(data_type).alias("data_type"), "tier", "record_count")
        out = part if out is None else out.unionByName(part)
    return out


def write_tiers(frame: DataFrame, ts_col: str, as_of, path: str) -> str:
    """SNK-6, the writer: rows as Parquet under ``tier=.../event_date=...``, so
    each tier can sit in its own storage class.  A day has the tier of its first
    moment; rows without a time stay hot (their age is unknown), expired ones
    are not written.  The days of ``frame`` replace what is stored for them, so
    a repeated run gives the same table; a day stored in another tier at an
    earlier ``as_of`` leaves it."""
    day = F.to_date(ts_col)
    tier = F.when(day.isNull(), "hot").otherwise(retention_tier("_start", as_of))
    frame.withColumn("_start", day.cast("timestamp_ntz")) \
        .withColumns({"tier": tier, "event_date": day}).drop("_start") \
        .filter("tier <> 'expired'").hint("rebalance", "tier", "event_date") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("tier", "event_date").parquet(path)
    _leave_former_tiers(frame.sparkSession, path, as_of)
    return path


def _tier_of(day: str, as_of) -> str:
    age = dt.datetime.fromisoformat(str(as_of)) - dt.datetime.fromisoformat(day)
    return next((t for t, n in S.RETENTION_DAYS if age <= dt.timedelta(days=n)), "expired")


def _day_folders(spark, path: str) -> dict[str, list[tuple[str, object]]]:
    """The folders of every stored day (at most seven years of them): day ->
    (tier, folder)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days: dict[str, list[tuple[str, object]]] = {}
    for name, _ in S.RETENTION_DAYS:
        folder = jvm.Path(root, f"tier={name}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            value = s.getPath().getName().removeprefix("event_date=")
            if value != "__HIVE_DEFAULT_PARTITION__":
                days.setdefault(value, []).append((name, s.getPath()))
    return days


def _leave_former_tiers(spark, path: str, as_of) -> None:
    """A day in two tiers was written again: the tier it has now holds it."""
    for day, stored in _day_folders(spark, path).items():
        tier = _tier_of(day, as_of)
        if len(stored) > 1 and any(name == tier for name, _ in stored):
            for name, folder in stored:
                if name != tier and not folder.getFileSystem(
                        spark._jsc.hadoopConfiguration()).delete(folder, True):
                    raise OSError(f"could not delete {folder}")


#: Day folders moved at the same time (an object store copies a folder to rename it).
MOVES_AT_ONCE = 16


def pending_moves(spark, path: str, as_of) -> list[tuple[str, str, str]]:
    """SNK-6, the mover's manifest: (event_date, from, to) of every stored day
    whose tier by ``as_of`` is another one.  It is read off the folders, so after
    a stop half-way it lists what is left."""
    return [(value, name, _tier_of(value, as_of)) for value, stored in sorted(_day_folders(spark, path).items())
            for name, _ in stored if name != _tier_of(value, as_of)]


def move_tiers(spark, path: str, as_of) -> list[tuple[str, str, str]]:
    """SNK-6, the mover: the day folders of ``pending_moves`` are renamed into
    the tier they have reached by ``as_of``, expired ones deleted; no row is
    read.  At most seven years of days are moved, MOVES_AT_ONCE together.  Returns the
    manifest; stopped half-way it can be run again.  Where a day already stands in
    its target too (a write stopped before it left the former tier, or a store whose
    renames are copies), nothing is deleted: an error asks for that day to be
    written again, which replaces both."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    moves = pending_moves(spark, path, as_of)
    for tier in {to for _, _, to in moves if to != "expired"}:
        if not fs.mkdirs(jvm.Path(root, f"tier={tier}")):
            raise OSError(f"could not make tier={tier} under {path}")

    def move(value: str, name: str, tier: str) -> None:
        day = jvm.Path(root, f"tier={name}/event_date={value}")
        target = jvm.Path(root, f"tier={tier}/event_date={value}")
        if tier != "expired" and fs.exists(target):
            raise OSError(f"{value} stands in tier={name} and tier={tier}; write it again")
        if not (fs.delete(day, True) if tier == "expired" else fs.rename(day, target)):
            raise OSError(f"could not move {day} to {tier}")

    with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
        list(pool.map(lambda m: move(*m), moves))
    return moves


def retention_events(tiers: DataFrame) -> DataFrame:
    """SNK-7: one data_retention record per data type and action."""
    act = F.create_map(*[x for k, v in RETENTION_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return tiers.select(
        F.lit("data_retention").alias("event_type"), F.lit("system").alias("user_id"),
        "data_type", act[F.col("tier")].alias("action"), "record_count")
