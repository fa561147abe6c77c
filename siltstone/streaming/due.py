"""Rows that are held until their time has come: sessions that end by themselves, files that have to settle.

The clock is the stream's watermark, so it is driven by the rows. The state of a key is the row seen last and a timer; it
goes when the row has been sent on, so nothing is left of keys whose time has come.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SETTLING_SECONDS = 120
HELD = "key string, due_ms long, payload string"


class Due(StatefulProcessor):
    """Sends on a key's row when its time comes, unless a later row has taken its place by then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due_ms long, payload string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), self.held.get()
        before = held
        for row in sorted(rows, key=lambda r: (r.seen_ms, r.due_ms)):
            if held is not None and held[0] <= row.seen_ms:
                yield Row(key=key[0], due_ms=held[0], payload=held[1])
            held = (row.due_ms, row.payload)
        if held is not None and held[0] <= now:
            yield Row(key=key[0], due_ms=held[0], payload=held[1])
            held = None
        if before is not None and (held is None or held[0] != before[0]):
            self.handle.deleteTimer(before[0])
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(held[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is not None and held[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield Row(key=key[0], due_ms=held[0], payload=held[1])

    def close(self) -> None:
        pass


def held_until(rows: DataFrame, key: str, seen_at: str, due_at: str, payload: str) -> DataFrame:
    """(key, due_ms, payload) of a stream's rows once their due time has come by the stream's clock.

    A row that comes while an earlier one of its key is held takes its place, if it was seen before that one was due. Rows
    of a key have to come in the order of seen_at, in one batch they are put in it; those without a time, and late ones that
    were seen before the clock, are passed over.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    known = rows.where(F.col(seen_at).isNotNull() & F.col(due_at).isNotNull()).withColumn("__clock", F.col(seen_at).cast("timestamp")).withWatermark("__clock", "0 seconds")
    told = known.select(F.col(key).cast("string").alias("key"), ms(seen_at).alias("seen_ms"), ms(due_at).alias("due_ms"), F.col(payload).cast("string").alias("payload"), "__clock")
    return told.groupBy("key").transformWithState(Due(), HELD, "Append", "EventTime")


def expired_sessions(sessions: DataFrame) -> DataFrame:
    """(session_id, expires_at) of a stream (session_id, seen_at, expires_at) of sessions and renewals, when they have run out."""
    found = held_until(sessions, "session_id", "seen_at", "expires_at", "session_id")
    return found.select(F.col("key").alias("session_id"), F.timestamp_millis("due_ms").alias("expires_at"))


def settled_files(listings: DataFrame, seconds: int = SETTLING_SECONDS) -> DataFrame:
    """(path, size_bytes, modified_at) of a stream of listings (path, size_bytes, modified_at, listed_at), once they have settled.

    A file that is old enough goes on at each listing; a younger one waits for the clock, and a newer listing of it takes
    its place.
    """
    due = listings.withColumn("__due", F.col("modified_at").cast("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS"))
    found = held_until(due, "path", "listed_at", "__due", "size_bytes")
    return found.select(F.col("key").alias("path"), F.col("payload").cast("long").alias("size_bytes"), F.timestamp_millis(F.col("due_ms") - seconds * 1000).alias("modified_at"))

