"""STR-3 with active sessions: a session is shown when it opens, whenever it
changes and when it closes.

``transformWithState`` is keyed by buckets of users, so a task makes a few state
calls per bucket and micro-batch and not some per session.  A bucket holds the open
sessions of its users (start, end, counts) as parallel arrays; one event-time timer,
at the earliest end plus the gap, closes what the watermark has passed.  Events of a
micro-batch are reduced to pieces before they touch the state, chunk by chunk, so
the state and the memory of a task grow with a bucket's open sessions, not with
its events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import WATERMARK, bucket_of_key

OUT = ("user_id string, start_us long, end_us long, interactions long, safety_blocks long, "
       "state string, version long")
_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Columns of sessions and pieces; a piece has version 0.
_COLS = ["user_id", "start_us", "end_us", "interactions", "safety_blocks", "version"]

#: Buckets of users; fixed for the life of a checkpoint.
USER_BUCKETS = 1024


class SessionTracker(StatefulProcessor):
    """Open sessions of a bucket of users.  States of a row: active (opened or
    changed), merged (an event joined it to an earlier one, which goes on), closed."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("sessions", "users array<string>, starts array<long>, ends array<long>, "
                                         "n array<long>, blocks array<long>, versions array<long>, timer long")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        """The open sessions and the time of the bucket's timer in ms."""
        *columns, timer = self.open.get() if self.open.exists() else (*([],) * len(_COLS), None)
        return pd.DataFrame({c: pd.Series(v, dtype=object if c == "user_id" else "int64")
                             for c, v in zip(_COLS, columns)}), timer

    def _hold(self, sessions: pd.DataFrame, timer: int | None, fired: bool = False) -> None:
        first = (int(sessions["end_us"].min()) + self.gap) // 1000 if len(sessions) else None
        if timer not in (None, first) and not fired:
            self.handle.deleteTimer(timer)
        if first is None:
            self.open.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.open.update((*(sessions[c].tolist() for c in _COLS), first))

    def handleInputRows(self, key, rows, timerValues):
        # pieces of this batch: apart by more than the gap; joined again whenever they have doubled
        parts, size = [], 0
        for chunk in rows:
            new = pd.DataFrame({"user_id": chunk["user_id"], "start_us": chunk["ts_us"], "end_us": chunk["ts_us"],
                                "interactions": 1, "safety_blocks": chunk["blocked"], "version": 0})
            parts.append(self._join(new))
            if sum(map(len, parts)) > 2 * size + len(new):
                parts = [self._join(pd.concat(parts))]
                size = len(parts[0])
        if not parts:
            return
        held, timer = self._held()
        after = self._join(pd.concat([held, *parts], ignore_index=True))
        was, now = (pd.MultiIndex.from_frame(f[["user_id", "start_us"]]) for f in (held, after))
        top = after["user_id"].map(held.groupby("user_id")["version"].max()).fillna(0).astype("int64") + 1
        old = was.get_indexer(now)
        known = old >= 0
        same = known.copy()
        for c in ("end_us", "interactions", "safety_blocks"):
            same[known] &= after[c].to_numpy()[known] == held[c].to_numpy()[old[known]]
        after["version"] = top.to_numpy()
        after.loc[same, "version"] = held["version"].to_numpy()[old[same]]
        # an open session that does not start one any more belongs to an earlier one
        gone = held[now.get_indexer(was) < 0]
        gone = gone.assign(state="merged", version=gone["user_id"].map(top.groupby(after["user_id"]).max()))
        self._hold(after, timer)
        yield pd.concat([gone, after[~same].assign(state="active")])[_NAMES]

    def _join(self, pieces: pd.DataFrame) -> pd.DataFrame:
        """Pieces of a user that are no more than the gap apart become one."""
        if not len(pieces):
            return pieces
        user = pd.factorize(pieces["user_id"])[0]
        order = np.lexsort((pieces["start_us"], user))
        p, user = pieces.iloc[order].reset_index(drop=True), user[order]
        start, reach = p["start_us"].to_numpy(), p["end_us"].groupby(user).cummax().to_numpy()
        new = np.r_[True, (user[1:] != user[:-1]) | (start[1:] - reach[:-1] > self.gap)]
        at = np.flatnonzero(new)
        out = p.loc[at, _COLS].reset_index(drop=True)
        out["end_us"] = np.maximum.reduceat(p["end_us"].to_numpy(), at)
        for c in ("interactions", "safety_blocks"):
            out[c] = np.add.reduceat(p[c].to_numpy(), at)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        held, timer = self._held()
        past = (held["end_us"] + self.gap) // 1000 <= mark
        closed = held[past].assign(state="closed", version=held["version"] + 1)
        self._hold(held[~past], timer, fired=True)
        yield closed[_NAMES]

    def close(self) -> None:
        pass


def session_changes(events: DataFrame, gap_minutes: int = 60, delay: str = WATERMARK) -> DataFrame:
    """A row for every change of a session; events without a user or a time
    belong to none."""
    e = events.filter(F.col("user_id").isNotNull() & F.col("event_time").isNotNull()) \
        .withWatermark("event_time", delay).select(
        bucket_of_key("user_id", USER_BUCKETS).alias("bucket"), "user_id", "event_time", F.unix_micros("event_time").alias("ts_us"),
        F.coalesce(F.col("event_type") == "safety_block", F.lit(False)).cast("bigint").alias("blocked"))
    return e.groupBy("bucket").transformWithStateInPandas(
        SessionTracker(gap_minutes * 60_000_000), OUT, "Append", "EventTime")


def current_sessions(changes: DataFrame) -> DataFrame:
    """Every session in its last state (active or closed)."""
    last = changes.groupBy("user_id", "start_us").agg(F.max_by(
        F.struct("end_us", "interactions", "safety_blocks", "state"), F.struct("version", F.col("state") == "closed"))
        .alias("s"))
    def at(us):
        return F.timestamp_micros(us).cast("timestamp_ntz")
    return last.filter("s.state <> 'merged'").select(
        "user_id", at(F.col("start_us")).alias("start_time"), at(F.col("s.end_us")).alias("end_time"),
        "s.interactions", "s.safety_blocks", "s.state")
