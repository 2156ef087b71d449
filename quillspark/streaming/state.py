"""Lifecycles of operations as keyed state with timers: one state an operation, kept in the executors' state stores.

Events (id, status, at, seq) of a stream go to their operation's state, whatever order they come in: the
latest by (at, seq) counts. Each change is appended to files as a row of its own, never all states at once.
A state is dropped, with a row that says so, ``ttl`` seconds of event time after its last event, and at
once when it is cancelled. A run that was stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.jobs import FINAL, TTL_SECONDS

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGE = "id {0}, status string, created_at timestamp, updated_at timestamp, n_events long, is_final boolean, gone boolean"


def _micros(t: datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us", tz="UTC")


class Lifecycle(StatefulProcessor):
    """status, seq, created, updated (microseconds), n_events, timer (milliseconds) of one operation."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("operation", "status string, seq long, created long, updated long, n_events long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        status, seq, created, updated, n, timer = held or (None, None, None, None, 0, None)
        for batch in rows:
            for own, at, number in zip(batch["status"], batch["micros"], batch["seq"]):
                n += 1
                created = at if created is None else min(created, at)
                if updated is None or (at, number, own or "") >= (updated, seq, status or ""):
                    status, seq, updated = own, number, at
        if timer is not None:
            self.handle.deleteTimer(timer)
        gone = status == "cancelled"
        if gone:
            self.state.clear()
        else:
            timer = -(-(updated + self.ttl * 1_000_000) // 1000)
            self.handle.registerTimer(timer)
            self.state.update((status, int(seq), int(created), int(updated), n, int(timer)))
        yield self._row(key, status, created, updated, n, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, _, created, updated, n, timer = self.state.get()
            if timer <= expiredTimerInfo.getExpiryTimeInMs():  # else one of a state since renewed
                self.state.clear()
                yield self._row(key, status, created, updated, n, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, status, created, updated, n, gone) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "status": [status], "created_at": [_time(created)], "updated_at": [_time(updated)], "n_events": [n], "is_final": [status in FINAL], "gone": [gone]})


def changes(events: DataFrame, ttl: int = TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """A stream of changes (see CHANGE) from a stream of events (id, status, at, seq), which may come ``late``. A null seq counts as the lowest."""
    events.sparkSession.conf.set(*STORE)
    own = events.select("id", "status", F.col("at").cast("timestamp").alias("at"), F.coalesce("seq", F.lit(-(2**63))).alias("seq"))
    own = own.withColumn("micros", F.unix_micros("at"))
    schema = CHANGE.format(events.schema["id"].dataType.simpleString())
    return own.withWatermark("at", late).groupBy("id").transformWithStateInPandas(Lifecycle(ttl), schema, "Append", "EventTime")


def follow(events: DataFrame, path: str, checkpoint: str, ttl: int = TTL_SECONDS, late: str = "0 seconds") -> None:
    """Appends the changes by all events there are now to the files in ``path``, and returns."""
    query = changes(events, ttl, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def settled(rows: DataFrame) -> DataFrame:
    """The last change of each operation; an aggregation over the change log."""
    rest = [c for c in rows.columns if c != "id"]
    order = ["updated_at", "n_events", "gone"]
    last = F.max(F.struct(*order, *(c for c in rest if c not in order)))
    return rows.groupBy("id").agg(last.alias("s")).select("id", *(F.col(f"s.{c}").alias(c) for c in rest))


def kept(rows: DataFrame) -> DataFrame:
    """States that haven't been dropped."""
    return settled(rows).filter("not gone").drop("gone")
