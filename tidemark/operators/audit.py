"""Archive audit: holes between captures, and whether an event without captures was missed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(events: DataFrame, captures: DataFrame, keys: Sequence[str], start: str, at: str, window: int, limit: int) -> DataFrame:
    """Holes (keys, from, to) longer than limit along the captures of [start - window, start], the start being the last point.

    Late first captures are no hole; no capture at all is one over the whole window."""
    inside = F.col(at).between(F.col(start) - window, F.col(start) - 1)
    known = captures.join(events, list(keys)).where(inside).select(*keys, start, at).distinct()
    w = Window.partitionBy(*keys).orderBy(at)
    found = known.select(*keys, F.col(at).alias("from"), F.coalesce(F.lead(at).over(w), F.col(start)).alias("to")).where(F.col("to") - F.col("from") > limit)
    none = events.join(known.select(*keys), list(keys), "left_anti").select(*keys, (F.col(start) - window).alias("from"), F.col(start).alias("to"))
    return found.unionByName(none)


def classes(events: DataFrame, captures: DataFrame, runs: DataFrame, keys: Sequence[str], start: str, at: str, window: int) -> DataFrame:
    """keys, class: ``priced``, or without captures ``unpriced`` if a capture run fell in the window (the market had no
    price), else ``miss``. Runs and events are laid on a grid of windows, so no event meets all runs."""
    inside = F.col(at).between(F.col(start) - window, F.col(start))
    priced = captures.join(events, list(keys)).where(inside).select(*keys).distinct().withColumn("priced", F.lit(True))
    lasts = runs.groupBy(F.floor(F.col("run") / window).alias("cell")).agg(F.max("run").alias("last"), F.min("run").alias("first"))
    # a window [start - window, start) touches two cells: the tail of one and the head of the next
    low, high = F.floor((F.col(start) - window) / window), F.floor(F.col(start) / window)
    tail = lasts.select(F.col("cell").alias("c1"), F.col("last").alias("last1"))
    head = lasts.select(F.col("cell").alias("c2"), F.col("first").alias("first2"))
    lit = events.withColumn("c1", low).withColumn("c2", high).join(tail, "c1", "left").join(head, "c2", "left")
    alive = F.coalesce(F.col("last1") >= F.floor((F.col(start) - window) / 60_000_000) * 60_000_000, F.lit(False)) | F.coalesce(F.col("first2") < F.floor(F.col(start) / 60_000_000) * 60_000_000, F.lit(False))
    said = F.when(F.coalesce("priced", F.lit(False)), "priced").when(alive, "unpriced").otherwise("miss")
    return lit.join(priced, list(keys), "left").select(*keys, said.alias("class"))


def days(events: DataFrame, captures: DataFrame, keys: Sequence[str], start: str, at: str, window: int) -> DataFrame:
    """Of each UTC day with events their number, how many have a capture in [start - window, start], and the day's capture
    runs (different minutes) and rows. events: keys, start; captures: keys, at (instants in micros). Both are summed by day before they meet."""
    day = lambda c: F.date_from_unix_date(F.floor(F.col(c) / 86_400_000_000).cast("int"))
    inside = F.col(at).between(F.col(start) - window, F.col(start))
    priced = captures.select(*keys, at).join(events.select(*keys, start), list(keys)).where(inside).select(*keys).distinct().withColumn("__priced", F.lit(True))
    by_day = events.join(priced, list(keys), "left").groupBy(day(start).alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_if("__priced").alias("events_with_pregame"))
    minutes = captures.groupBy(F.floor(F.col(at) / 60_000_000).alias("__minute")).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__at"))
    runs = minutes.groupBy(day("__at").alias("day")).agg(F.count(F.lit(1)).alias("capture_runs"), F.sum("__n").alias("snapshot_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return by_day.join(runs, "day", "left").select("day", "events", "events_with_pregame", zero("capture_runs"), zero("snapshot_rows"))


def is_red(gapped: int, missed: int, orphans: int) -> bool:
    """Whether an audit asks for action: holes in priced events, misses or orphans; unpriced events alone don't."""
    return gapped > 0 or missed > 0 or orphans > 0
