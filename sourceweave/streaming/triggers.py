"""Aggregations that work on a stream and, unchanged, on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_windows(events: DataFrame, keys: list[str], width: str, slide: str | None = None) -> DataFrame:
    """Events per key and time window (tumbling, or sliding when ``slide`` is given)."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(win.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 100).cast("bigint")).alias("cents")
    ).select(F.col("w.start").alias("window_start"), *keys, "n", "cents")


def recurate_triggers(
    events: DataFrame, keys: list[str], width: str, flagged: Column, threshold: int, slide: str | None = None
) -> DataFrame:
    """Items whose flagged signals in a window reach the threshold."""
    return usage_windows(events.filter(flagged), keys, width, slide).filter(F.col("n") >= threshold)


def usage_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions per user: signals at most ``gap`` apart."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    ).select("user_id", F.col("w.start").alias("session_start"), "n", "last_ts")


def usage_sessions_table(events: DataFrame, gap: str) -> DataFrame:
    """:func:`usage_sessions` for a stored table in which one user may hold a large part of the rows.

    Sessions are formed per user and day first; only those, not the signals, meet per user to be joined
    where one day's last session runs on into the next.
    """
    by_day = events.withColumn("_day", F.to_date("ts")).groupBy(F.session_window("ts", gap).alias("w"), "user_id", "_day").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    ).select("user_id", F.col("w.start").alias("start"), "n", "last_ts")
    return _joined(by_day, gap)


def _joined(spans: DataFrame, gap: str) -> DataFrame:
    """Sessions from spans (user_id, start, n, last_ts) of which some run on into others."""
    reach = F.max("last_ts").over(W.partitionBy("user_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > reach + F.expr(f"INTERVAL {gap}"), F.lit(True))
    marked = spans.withColumn("_new", fresh.cast("int")).withColumn(
        "_s", F.sum("_new").over(W.partitionBy("user_id").orderBy("start"))
    )
    return marked.groupBy("user_id", "_s").agg(
        F.min("start").alias("session_start"), F.sum("n").alias("n"), F.max("last_ts").alias("last_ts")
    ).drop("_s")


def complete_sessions(events: DataFrame, closed: DataFrame, gap: str) -> DataFrame:
    """All sessions of ``events``, given those that a stream has closed (user_id, session_start, n, last_ts).

    Signals that no closed session covers are still open or came behind the watermark. They are found on (user, day),
    form spans of their own, and join the closed ones where the gap allows, so the result is that of
    :func:`usage_sessions_table`. A signal counts as covered if it lies within a closed session of its user, so a late one
    inside a session that closed without it is not added to that session's count.
    """
    days = closed.select("user_id", F.col("session_start").alias("_from"), F.col("last_ts").alias("_to"))
    days = days.withColumn("_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
    dated = events.select("user_id", "ts", F.to_date("ts").alias("_day"))
    on = dated["user_id"].eqNullSafe(days["user_id"]) & (dated["_day"] == days["_day"]) & dated["ts"].between(days["_from"], days["_to"])
    left = dated.join(days, on, "left_anti").select("user_id", "ts")
    rest = usage_sessions_table(left, gap).select("user_id", F.col("session_start").alias("start"), "n", "last_ts")
    return _joined(closed.select("user_id", F.col("session_start").alias("start"), "n", "last_ts").unionByName(rest), gap)


def job_state(events: DataFrame) -> DataFrame:
    """Latest status and stage per job and the number of events seen."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("stage", at).alias("stage"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def webhook_events(events: DataFrame) -> DataFrame:
    """Event kind per log row, as a subscriber would receive it."""
    kind = (
        F.when(F.col("status") == "completed", "job.completed")
        .when(F.col("status") == "failed", "job.failed")
        .when(F.col("status") == "review_required", "job.review_required")
        .otherwise("job.stage_changed")
    )
    return events.withColumn("kind", kind)


def source_updates(fetches: DataFrame, order: list[str], bucket: Callable[[], Column]) -> DataFrame:
    """Fetches whose content hash differs from the one before for the same URL.

    ``fetches``: url, content_hash and the columns of ``order``; ``bucket`` maps a row to a coarse step of
    that order (a day, say). Neighbours are compared inside each (url, bucket), and across buckets only
    each bucket's first and last row meet, so a URL fetched very often is spread over its buckets.
    """
    rows = fetches.withColumn("_b", bucket())
    inside = W.partitionBy("url", "_b").orderBy(*order)
    at = F.struct(*order)
    edges = rows.groupBy("url", "_b").agg(F.max_by("content_hash", at).alias("_last"))
    before = edges.withColumn("_carried", F.lag("_last").over(W.partitionBy("url").orderBy("_b"))).drop("_last")
    prev = rows.withColumn("_prev", F.lag("content_hash").over(inside)).withColumn("_n", F.row_number().over(inside))
    joined = prev.join(before, ["url", "_b"])
    previous = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    return (
        joined.withColumn("previous_hash", previous)
        .filter(F.col("previous_hash").isNotNull() & (F.col("previous_hash") != F.col("content_hash")))
        .drop("_b", "_prev", "_n", "_carried")
    )


def affected_units(updates: DataFrame, citations: DataFrame) -> DataFrame:
    """Units that cite a URL whose content changed."""
    changed = updates.groupBy("url").agg(F.count(F.lit(1)).alias("n_changes"))
    return citations.select("run_id", "path", "url").distinct().join(changed, "url")
