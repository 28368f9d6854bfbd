"""Which stored event a feed row means: tiers of equi-joins, each on what the tier before left over; ambiguity is refused.

Choices that depend on the choices before them are made in sessions: a pair of teams' time line, feed rows and candidate events
together, is cut wherever no candidate pair spans the cut. What happens in one session can't touch another one, so
rows are dealt by session, sorted, and read through once; a task holds one session, whatever a pair of teams' history.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.session import ship

#: Distances between starts at which a re-issued id, and an event that has no id yet, may be the same game.
RESTAMP_US, MERGE_US = 5 * 60_000_000, 3 * 3_600_000_000
#: Windows of a session's time cells: how many distances a cell is long.
CELL_REACH = 64
TEAMS = ("home", "away")


def sessions(rows: DataFrame, keys: tuple[str, ...], at: str, kind: str, within: int) -> DataFrame:
    """rows with ``session``: the time of the last cut of their keys' time line. A cut stands before an instant if no two rows of different
    kind (a boolean column) on either side of it are at most ``within`` apart. Cells with guests from both sides keep windows short."""
    width = CELL_REACH * max(1, within)
    near = asof.spread(rows, at, asof.cells_of(width), back=within, ahead=within)
    w = Window.partitionBy(*keys, "__cell").orderBy(at)
    back, ahead = w.rangeBetween(-within, -1), w.rangeBetween(0, within)
    t, one = F.col(at), F.col(kind)
    seen = [F.max(F.when(c, t)).over(back) for c in (one, ~one)]
    next_ = [F.min(F.when(c, t)).over(ahead) for c in (one, ~one)]
    crossed = F.coalesce(next_[0] - seen[1] <= within, F.lit(False)) | F.coalesce(next_[1] - seen[0] <= within, F.lit(False))
    cut = near.withColumn("__cut", F.when(~crossed, t)).where("__own").drop("__own", "__cell")
    return asof.running_max(cut, keys, at, width, F.col("__cut"), "session").drop("__cut")


class Candidates:
    """A session's events by start, each of which may be taken once."""

    def __init__(self, events: list[dict]):
        self.up = sorted(events, key=lambda e: (e["at"], e["event_id"]))
        self.down = sorted(events, key=lambda e: (-e["at"], e["event_id"]))
        self.starts, self.ends = [e["at"] for e in self.up], [-e["at"] for e in self.down]
        self.taken: set = set()

    def nearest(self, at: int, within: int) -> Iterator[tuple[int, object]]:
        """(distance, event id) of the events in reach, nearest first, ties by id."""
        ahead = ((e["at"] - at, e["event_id"]) for e in _from(self.up, bisect.bisect_left(self.starts, at)))
        back = ((at - e["at"], e["event_id"]) for e in _from(self.down, bisect.bisect_right(self.ends, -at)))
        for gap, event in heapq.merge(ahead, back):
            if gap > within:
                return
            yield gap, event


def _from(rows: list, at: int) -> Iterator:
    for k in range(at, len(rows)):
        yield rows[k]


def in_turn(feed: list[dict], events: list[dict], restamp: int, merge: int) -> Iterator[tuple]:
    """(feed_id, event_id, action) of a session's feed rows in their order, each seeing what the rows before it have taken.

    An event whose id the cycle no longer has is restamped if it is the only one in reach; with several the row is refused there. Then the nearest
    event without an id takes it; else a new event is due. An id that was stamped by a later capture than the row's isn't superseded by it."""
    stale, free = Candidates([e for e in events if e["stale"]]), Candidates([e for e in events if not e["stale"]])
    stamped = {e["event_id"]: e["stamped_us"] for e in events}
    for row in feed:
        old = [e for _, e in stale.nearest(row["at"], restamp) if e not in stale.taken and (stamped[e] is None or row["captured_us"] is None or stamped[e] <= row["captured_us"])]
        if len(old) == 1:
            stale.taken.add(old[0])
            yield row["feed_id"], old[0], "restamped"
            continue
        event = next((e for _, e in free.nearest(row["at"], merge) if e not in free.taken), None)
        if event is not None:
            free.taken.add(event)
            yield row["feed_id"], event, "merged"
        else:
            yield row["feed_id"], None, "created_ambiguous" if old else "created"


def nearest_first(feed: list[dict], events: list[dict], within: int) -> Iterator[tuple]:
    """(feed_id, event_id) of a greedy one-to-one match, nearest starts first, ties by both ids. One candidate of each feed row is held at a time."""
    free = Candidates(events)
    left = []
    for row in feed:
        others = free.nearest(row["at"], within)
        first = next(others, None)
        if first:
            left.append((first[0], row["feed_id"], first[1], others))
    heapq.heapify(left)
    while left:
        _, row, event, others = heapq.heappop(left)
        if event not in free.taken:
            free.taken.add(event)
            yield row, event
            continue
        following = next((x for x in others if x[1] not in free.taken), None)
        if following:
            heapq.heappush(left, (following[0], row, following[1], others))


def _settled(feed: DataFrame, events: DataFrame, within: int, order: list[str], settle: Callable, schema: str) -> DataFrame:
    """What ``settle(feed rows, events)`` gives for every session. feed: feed_id, home, away, at, captured_us and order columns; events:
    event_id, home, away, at, stale, stamped_us."""
    ship(feed.sparkSession)
    both = feed.withColumn("__feed", F.lit(True)).unionByName(events.withColumn("__feed", F.lit(False)), allowMissingColumns=True)
    cut = sessions(both, TEAMS, "at", "__feed", within)
    key = [*TEAMS, "session"]
    rows = cut.repartition(*key).sortWithinPartitions(*key, "__feed", *order)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, events_, feed_ = None, [], []
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=labels)
            found.clear()
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                row = dict(zip(names, values))
                this = tuple(row[k] for k in key)
                if this != at:
                    found += settle(feed_, events_) if feed_ else ()
                    at, events_, feed_ = this, [], []
                (feed_ if row["__feed"] else events_).append(row)
            if found:
                yield out()
        found += settle(feed_, events_) if feed_ else ()
        if found:
            yield out()

    ids = {"feed_id": rows.schema["feed_id"].dataType, "event_id": rows.schema["event_id"].dataType}
    labels = [x.split()[0] for x in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(ids[n]) if n in ids else pa.string() for n in labels]
    return rows.mapInArrow(run, schema.format(**{k: v.simpleString() for k, v in ids.items()}))


def resolve(feed: DataFrame, events: DataFrame, restamp: int = RESTAMP_US, merge: int = MERGE_US, order: str | None = None, live: DataFrame | None = None) -> DataFrame:
    """feed: feed_id, home, away, start_us (one cycle) and, if known, captured_us. events: event_id, home, away, start_us, odds_id (or NULL) and, if
    known, stamped_us (capture at which the id was set) and former_ids (an array of ids that it had).

    Gives feed_id, event_id (NULL: to be created) and action: ``matched`` by id (also a former one); ``restamped`` onto the one event of the teams
    within five minutes whose id the cycle no longer has; ``created_ambiguous`` if there are several; ``merged`` into the nearest id-less event
    within three hours; else ``created``. Rows go in turn by the column ``order``, or by start and id: each sees what those before it took. An id that
    the feed lists twice is settled once. live: all ids of the cycle (feed_id), where the feed holds but those that are to be resolved."""
    given = {"captured_us": "bigint", **({order: None} if order else {})}
    feed = feed.select("feed_id", *TEAMS, F.col("start_us").alias("at"), *[F.col(c) if c in feed.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()])
    feed = feed.dropDuplicates(["feed_id"]) if not order else asof.first_by(feed, ["feed_id"], [order])
    stamped = F.col("stamped_us") if "stamped_us" in events.columns else F.lit(None).cast("bigint")
    known = events.select("event_id", *TEAMS, F.col("start_us").alias("at"), "odds_id", stamped.alias("stamped_us"))
    ids = known.where("odds_id is not null")
    named = ids.select(F.col("odds_id").alias("feed_id"), "event_id", F.lit(0).alias("__old"))
    if "former_ids" in events.columns:
        named = named.unionByName(events.select(F.explode("former_ids").alias("feed_id"), "event_id", F.lit(1).alias("__old")))
    named = named.groupBy("feed_id").agg(F.min_by("event_id", F.struct("__old", "event_id")).alias("event_id"))
    exact = feed.join(named, "feed_id", "left")
    matched = exact.where("event_id is not null").select("feed_id", "event_id", F.lit("matched").alias("action"))
    rest = exact.where("event_id is null").drop("event_id")
    stale = ids.join((feed if live is None else live).select(F.col("feed_id").alias("odds_id")), "odds_id", "left_anti").withColumn("stale", F.lit(True))
    free = known.where("odds_id is null").withColumn("stale", F.lit(False))
    candidates = stale.unionByName(free).select("event_id", *TEAMS, "at", "stale", "stamped_us")
    turn = [order] if order else ["at", "feed_id"]
    placed = " is not null and ".join([*TEAMS, "at"]) + " is not null"  # without teams or a start a row means no known event
    lost = rest.where(f"not ({placed})").select("feed_id", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit("created").alias("action"))
    rest, candidates = rest.where(placed), candidates.where(placed)
    settled = _settled(rest, candidates, max(restamp, merge), turn, lambda f, e: in_turn(f, e, restamp, merge), "feed_id {feed_id}, event_id {event_id}, action string")
    return matched.unionByName(settled).unionByName(lost)


def assign(feed: DataFrame, free: DataFrame, within: int) -> DataFrame:
    """Greedy one-to-one assignment of feed rows to events of the same teams (start: s) at most ``within`` away, nearest starts first, each
    taken once: feed_id, event_id."""
    rows = feed.select("feed_id", *TEAMS, F.col("start_us").alias("at"))
    events = free.select("event_id", *TEAMS, F.col("s").alias("at"))
    rows, events = (x.dropna(subset=[*TEAMS, "at"]) for x in (rows, events))
    return _settled(rows, events, within, ["at", "feed_id"], lambda f, e: nearest_first(f, e, within), "feed_id {feed_id}, event_id {event_id}")


def writes(feed: DataFrame, events: DataFrame, resolved: DataFrame, new_id: Column) -> DataFrame:
    """The event rows that a cycle changes or adds: event_id, home, away, start_us, odds_id, stamped_us, former_ids. A new event takes the
    feed row's teams and start and the id ``new_id`` (an expression of feed_id); a known one keeps its start and remembers the id it had. An event
    that a later capture has stamped stays as it is. Applied twice, the writes are the same."""
    none = F.array().cast("array<string>")
    captured = F.col("captured_us") if "captured_us" in feed.columns else F.lit(None).cast("bigint")
    rows = resolved.where("action <> 'matched'").join(feed.dropDuplicates(["feed_id"]).select("feed_id", *TEAMS, "start_us", captured.alias("captured_us")), "feed_id")
    rows = rows.withColumn("event_id", F.coalesce("event_id", new_id))
    optional = {"stamped_us": F.lit(None).cast("bigint"), "former_ids": none}
    had = events.select("event_id", F.col("start_us").alias("__start"), F.col("odds_id").alias("__had"), *[(F.col(c) if c in events.columns else v).alias(f"__{c}") for c, v in optional.items()])
    joined = rows.join(had, "event_id", "left").where("__stamped_us is null or captured_us is null or __stamped_us <= captured_us")
    former = F.array_except(F.array_union(F.coalesce("__former_ids", none), F.array_compact(F.array(F.col("__had").cast("string")))), F.array(F.col("feed_id").cast("string")))
    return joined.select("event_id", *TEAMS, F.coalesce("__start", "start_us").alias("start_us"), F.col("feed_id").alias("odds_id"), F.col("captured_us").alias("stamped_us"), former.alias("former_ids"))


def repaired(snapshots: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orphan events' snapshots moved to the event that they belong to. pairs: orphan_id, event_id.

    snapshots: event_id, book, market, side, captured_at, price, is_closing. A row that its new event has already goes; of two
    closings of an outcome the sibling's stands; an orphan's closing is kept only if none exists. Gives snapshots, report."""
    key = ["event_id", "book", "market", "side", "captured_at"]
    moved = snapshots.join(pairs.select(F.col("event_id").alias("to_id"), F.col("orphan_id").alias("event_id")), "event_id", "left")
    moved = moved.withColumn("from_orphan", F.col("to_id").isNotNull()).withColumn("event_id", F.coalesce("to_id", "event_id")).drop("to_id")
    # the sibling's own row goes first; a closing flag of the duplicate that goes is handed to the row that stays
    same = Window.partitionBy(*key)
    moved = moved.withColumn("n", F.row_number().over(same.orderBy("from_orphan"))).withColumn("any_closing", F.max("is_closing").over(same))
    kept = moved.where("n = 1")
    outcome = Window.partitionBy("event_id", "book", "market", "side")
    own = F.max(F.when(~F.col("from_orphan"), F.col("is_closing")).otherwise(F.lit(False))).over(outcome)
    kept = kept.withColumn("own", own)
    last = F.row_number().over(outcome.orderBy(F.desc("any_closing"), F.desc("captured_at"))) == 1
    closing = F.when(F.col("own"), F.col("is_closing") & ~F.col("from_orphan")).otherwise(F.col("any_closing") & last)
    report = moved.where("from_orphan").agg(F.count_if(F.col("n") == 1).alias("repointed"), F.count_if(F.col("n") > 1).alias("duplicates"))
    return kept.withColumn("is_closing", closing).select(*snapshots.columns), report
