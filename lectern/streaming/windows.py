"""Counts by tumbling and sliding windows of a stream, merged into tables by key."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.streaming.sinks import upserts


def _counted(events: DataFrame, window, student: str, time: str, delay: str) -> DataFrame:
    rows = events.where(F.col(student).isNotNull() & F.col(time).isNotNull()).select(F.col(student).alias("user"), F.col(time).cast("timestamp").alias("at"))
    counted = rows.withWatermark("at", delay).groupBy("user", window(F.col("at")).alias("w")).agg(F.count("*").alias("events"))
    return counted.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def daily_counts(events: DataFrame, student: str = "user_id", time: str = "ts", delay: str = "2 days") -> DataFrame:
    """(user, start, end, events) of each UTC day, by tumbling windows (R12). Events later than the watermark are dropped."""
    return _counted(events, lambda at: F.window(at, "1 day"), student, time, delay)


def recent_counts(events: DataFrame, minutes: int = 15, every: int = 5, student: str = "user_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(user, start, end, events) of the last minutes, anew every few minutes, by sliding windows."""
    return _counted(events, lambda at: F.window(at, f"{minutes} minutes", f"{every} minutes"), student, time, delay)


def pane_counts(events: DataFrame, minutes: int = 15, every: int = 5, student: str = "user_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(user, start, end, events) of panes: the tumbling windows that sliding ones of `minutes`, anew `every` few, are made of.

    An event is in one pane, where recent_counts() has it in minutes / every windows, each a row of state and of the table.
    A late event counts, in all of its windows, as long as the last of them is not older than the watermark.
    """
    pane = gcd(minutes, every)
    return _counted(events, lambda at: F.window(at, f"{pane} minutes"), student, time, f"{delay} {minutes - pane} minutes")


def keep(counts: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = 10, buckets: int = 64) -> StreamingQuery:
    """Counts of a stream into a table by user and window. A window's count only grows, so the largest is the latest."""
    return upserts(counts, path, ["user", "start"], "events", checkpoint, once, seconds, buckets)


def active_at(counts: DataFrame, now) -> DataFrame:
    """Users with an event in the window that ends at `now`, or, between two ends, the last one that has ended, of windows with any event."""
    end = counts.where(F.col("end") <= F.lit(now).cast("timestamp")).agg(F.max("end").alias("end"))
    return counts.join(F.broadcast(end), "end").select("user").distinct()  # one row


def active_in(panes: DataFrame, now, minutes: int = 15, every: int = 5) -> DataFrame:
    """Users with an event in the sliding window that ends at `now`, or, between two ends, the last one that has ended.

    Windows start on whole steps since 1970, as those of recent_counts(). A window without events has no users.
    """
    at, length, step = F.unix_micros(F.lit(now).cast("timestamp")), F.lit(minutes * 60_000_000), F.lit(every * 60_000_000)
    end = at - F.pmod(at - length, step)
    return panes.where((F.col("start") >= F.timestamp_micros(end - length)) & (F.col("start") < F.timestamp_micros(end))).select("user").distinct()
