"""Lifecycles of jobs and operations as append-only events; ``state`` has them as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of an operation in order, final ones, and how long states are kept.
STATES = ("notStarted", "running", "succeeded", "failed")
FINAL = ("succeeded", "failed", "cancelled", "done")
TTL_SECONDS = 3600
ALLOWED = {"notStarted": ("running", "failed"), "running": ("succeeded", "failed", "cancelled"), "queued": ("running", "cancelled"), "pending": ("running",)}


def latest(events: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The last state of each key; an aggregation, so hot keys shrink before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(at, *(c for c in rest if c != at))).alias("s")).select(key, "s.*").select(*events.columns)


def lifecycle(events: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """key, status, created_at, updated_at, n_events, is_final."""
    out = events.groupBy(key).agg(F.max_by("status", F.struct(at, "status")).alias("status"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count(F.lit(1)).alias("n_events"))
    return out.withColumn("is_final", F.col("status").isin(*FINAL))


def alive(states: DataFrame, now, ttl: int = TTL_SECONDS) -> DataFrame:
    """States not older than ``ttl`` seconds; cancelled ones go at once."""
    return states.filter((F.col("updated_at") > F.lit(now) - F.make_interval(secs=F.lit(ttl))) & (F.col("status") != "cancelled"))


def can_follow(before: str, after: str) -> bool:
    return after in ALLOWED.get(before, ())
