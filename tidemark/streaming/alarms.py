"""The archive audit as an alarm: holes between captures are told while the event can still be saved.

Two kinds of rows come on one stream, dealt by event: that an event is due (its start), and that a price was captured. The state of each event
holds its start, the last capture that the watermark has passed, and those that it hasn't; event-time timers fire when the next capture
is overdue and at the start. So captures that come late or out of order within the watermark's delay count at their own time, and a restart goes
on from the state. An event's state is dropped at its start. States are kept in buckets of events by hash, so that a batch calls Python once a bucket and
trigger; a bucket holds the events that are live at once over the number of buckets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: Rows of the stream: a listing has a start and no capture, a capture no start; ``seen`` is when either was known.
ROWS = "event_id string, start_us bigint, at_us bigint, seen timestamp"
ALARMS = "event_id string, kind string, from_us bigint, to_us bigint"
#: A bucket's events, one after the other; ``counts``: how many of ``pending`` are each one's.
STATE = "events array<string>, starts array<bigint>, lasts array<bigint>, told array<boolean>, counts array<int>, pending array<bigint>"
#: Buckets that events are dealt to. It is fixed for a stream's life, since states are kept by it.
BUCKETS = 4096


class Watch:
    """One event between its listing and its start; times in microseconds."""

    def __init__(self, window: int, limit: int, start: int | None = None, last: int | None = None, pending=(), told: bool = False):
        self.window, self.limit, self.start, self.last, self.told = window, limit, start, last, told
        self.pending = sorted(set(pending))

    def up_to(self, now: int) -> Iterator[tuple[str, int, int | None]]:
        """(kind, from, to) of what is known when all rows until ``now`` are: ``overdue`` once a hole is longer than the limit, ``hole`` when it ends."""
        if self.start is None:
            return
        known = bisect_right(self.pending, min(now, self.start - 1))
        passed, self.pending = self.pending[:known], self.pending[known:]
        for at in passed:
            if at < self.start - self.window:
                continue
            if self.last is not None and at - self.last > self.limit:
                yield "hole", self.last, at
            self.last, self.told = max(at, self.last or at), False
        if now >= self.start:
            since = self.start - self.window if self.last is None else self.last
            if self.last is None or self.start - self.last > self.limit:
                yield "hole", since, self.start
        elif self.last is not None and not self.told and now - self.last > self.limit and self.start - self.last > self.limit:
            self.told = True
            yield "overdue", self.last, None

    def next_time(self) -> int | None:
        """When something may become known without a new row."""
        if self.start is None:
            return None
        due = [self.start] + self.pending[:1]
        if self.last is not None and not self.told and self.start - self.last > self.limit:
            due.append(self.last + self.limit + 1)
        return min(due)


def _watches(state: tuple, window: int, limit: int) -> dict[str | None, Watch]:
    """A bucket's events from its state."""
    out, place = {}, 0
    for event, start, last, told, n in zip(*state[:5]):
        out[event] = Watch(window, limit, start, last, state[5][place : place + n], told)
        place += n
    return out


def _state(watches: dict[str | None, Watch]) -> tuple:
    own = list(watches.values())
    return (list(watches), [w.start for w in own], [w.last for w in own], [w.told for w in own], [len(w.pending) for w in own], [x for w in own for x in w.pending])


def gaps(rows: DataFrame, window: int, limit: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Alarms of a stream of listings and captures (``ROWS``): ``overdue`` (to: NULL) as soon as an event has had no capture for over ``limit``
    microseconds, ``hole`` when it is over. Holes are those that ``audit.gaps`` finds in the whole archive: along the captures of [start - window,
    start), the start being the last point; none before the first capture, but one over the whole window if there is none.

    Of several listings of a batch the one with the last ``seen`` gives the start, of equal ones the latest start."""

    ship(rows.sparkSession)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        watches = _watches(state.get, window, limit) if state.exists else {}
        if not state.hasTimedOut:
            listed: dict = {}
            taken: dict = {}
            for pdf in frames:
                own = pdf.dropna(subset=["at_us"])
                for event, at in zip(own["event_id"].tolist(), own["at_us"].astype("int64").tolist()):
                    taken.setdefault(event, set()).add(at)
                own = pdf.dropna(subset=["start_us"])
                for event, *said in zip(own["event_id"].tolist(), own["seen"].tolist(), own["start_us"].astype("int64").tolist()):
                    listed[event] = max(listed.get(event, said), said)
            for event in {**taken, **listed}:
                watch = watches.setdefault(event, Watch(window, limit))
                watch.pending = sorted(taken.get(event, set()).union(watch.pending))
                watch.start = listed[event][1] if event in listed else watch.start
        now = state.getCurrentWatermarkMs() * 1000
        found = [(event, *x) for event, watch in watches.items() for x in watch.up_to(now)]
        watches = {event: w for event, w in watches.items() if w.start is None or now < w.start}
        if watches:
            state.update(_state(watches))
            due = min((t for w in watches.values() if (t := w.next_time()) is not None), default=None)
            if due is not None:
                state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["event_id", "kind", "from_us", "to_us"]).astype({"from_us": "Int64", "to_us": "Int64"})

    dealt = rows.withWatermark("seen", late).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, ALARMS, STATE, "append", "EventTimeTimeout")


def source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Listings and captures that land as JSON files."""
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).json(folder)


def run(spark: SparkSession, folder: str, out: str, window: int, limit: int, late: str = "10 minutes", files: int = 1):
    """Appends the alarms of what has landed to a Parquet table; progress and state are kept beside it."""
    found = gaps(source(spark, folder, files), window, limit, late)
    return found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}.progress").trigger(availableNow=True).start()


def listed(events: DataFrame, captures: DataFrame, start: str, at: str, window: int) -> DataFrame:
    """Rows of the stream from an archive: events (event_id, start) seen when their window begins, captures (event_id, at) when they were taken."""
    micros = lambda c: F.timestamp_micros(c)
    none = F.lit(None).cast("bigint")
    own = events.select(F.col("event_id").cast("string"), F.col(start).alias("start_us"), none.alias("at_us"), micros(F.col(start) - window).alias("seen"))
    return own.unionByName(captures.select(F.col("event_id").cast("string"), none.alias("start_us"), F.col(at).alias("at_us"), micros(F.col(at)).alias("seen")))


def tick(spark: SparkSession, at_us: int) -> DataFrame:
    """A row that only moves the watermark on."""
    return spark.createDataFrame([("", None, None, at_us)], "event_id string, start_us bigint, at_us bigint, t bigint").select("event_id", "start_us", "at_us", F.timestamp_micros("t").alias("seen"))
