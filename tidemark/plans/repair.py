"""Repair of orphan events: what the price feed made and the schedule never knew is drained into the event that it belongs to.

One plan gives the events, the prices and a report; a dry run is the same plan whose tables nobody writes, and a second run finds no orphan
left to move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.session import cut

REPAIRABLE, ALONE, AMBIGUOUS, CYCLE = "repairable", "no_sibling", "ambiguous", "cycle"
_KEY = ["event_id", "book", "market", "side", "captured_at"]
_OUTCOME = ["event_id", "book", "market", "side"]


def orphans(events: DataFrame, within: int = identity.RESTAMP_US) -> DataFrame:
    """Orphans (an odds id, no schedule id) with their state, and the one scheduled event of their teams within reach: orphan_id, odds_id, state,
    event_id (NULL unless repairable), siblings. events: event_id, home, away, start_us, odds_id, schedule_id."""
    lost = events.where("odds_id is not null and schedule_id is null").select(F.col("event_id").alias("orphan_id"), "home", "away", "start_us", "odds_id")
    known = events.where("schedule_id is not null").select("event_id", "home", "away", F.col("start_us").alias("s"))
    cell = lambda t: F.floor(F.col(t) / F.lit(max(1, within)))
    near = known.withColumn("cell", F.explode(F.array(cell("s") - 1, cell("s"), cell("s") + 1)))
    met = lost.withColumn("cell", cell("start_us")).join(near, ["home", "away", "cell"]).where(F.abs(F.col("s") - F.col("start_us")) <= within)
    found = met.groupBy("orphan_id").agg(F.sort_array(F.collect_list("event_id")).alias("siblings"))  # those of one instant: few
    all_ = lost.join(found, "orphan_id", "left").withColumn("n", F.coalesce(F.size("siblings"), F.lit(0)))
    state = F.when(F.col("n") == 1, REPAIRABLE).when(F.col("n") > 1, AMBIGUOUS).otherwise(ALONE)
    return all_.select("orphan_id", "odds_id", state.alias("state"), F.when(F.col("n") == 1, F.col("siblings")[0]).alias("event_id"), "siblings")


def ends(pairs: DataFrame) -> DataFrame:
    """Pairs (orphan_id, event_id) whose event may itself be an orphan, resolved to the end of the chain: orphan_id, event_id, state. A chain that
    comes back to itself has no end; its pairs are told as cycles. Each round doubles the steps taken, so rounds are the digits of the pairs' number."""
    now = cut(pairs.select("orphan_id", "event_id"))
    for _ in range(now.count().bit_length()):
        on = now.select(F.col("orphan_id").alias("event_id"), F.col("event_id").alias("__next"))
        after = cut(now.join(on, "event_id", "left").select("orphan_id", F.coalesce("__next", "event_id").alias("event_id"), F.col("__next").isNotNull().alias("__moved")))
        now = after.drop("__moved")
        if after.where("__moved").isEmpty():
            break
    lost = now.select(F.col("orphan_id").alias("event_id")).distinct().withColumn("__lost", F.lit(True))  # whoever still points to an orphan never ends
    told = now.join(lost, "event_id", "left")
    return told.select("orphan_id", F.when(F.col("__lost").isNull(), F.col("event_id")).alias("event_id"), F.when(F.col("__lost"), CYCLE).otherwise(REPAIRABLE).alias("state"))


def repair(events: DataFrame, snapshots: DataFrame, pairs: DataFrame, hand_over: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events and snapshots after the repair, and a report. pairs: orphan_id, event_id, odds_id; other states than repairable (where there is a
    column ``state``) are left out. hand_over: the event takes the orphan's odds id, as the feed's current one; a pair that a person has
    certified keeps its own.

    Snapshots: event_id, book, market, side, captured_at, price, is_closing. Of an outcome the sibling's closing stands, else that of its first
    orphan by id; a row that the sibling has at the same instant goes and leaves it its closing; the others are repointed. The orphan is deleted.
    Report by orphan: event_id, demoted, promoted, duplicates, repointed."""
    todo = pairs.where(F.col("state") == REPAIRABLE) if "state" in pairs.columns else pairs
    todo = todo.select("orphan_id", F.col("event_id").alias("to_id"), *(["odds_id"] if "odds_id" in pairs.columns else []))
    moves = todo.select(F.col("orphan_id").alias("event_id"), "to_id")
    touched = todo.select(F.col("to_id").alias("event_id")).distinct().withColumn("__touched", F.lit(True))
    rows = snapshots.join(moves, "event_id", "left").withColumn("orphan_id", F.when(F.col("to_id").isNotNull(), F.col("event_id")))
    rows = rows.withColumn("event_id", F.coalesce("to_id", "event_id")).drop("to_id").join(touched, "event_id", "left")
    quiet, ours = rows.where("__touched is null").select(*snapshots.columns), rows.where("__touched")  # most rows go past untouched
    own = F.col("orphan_id").isNull()
    same = Window.partitionBy(*_KEY)
    outcome = Window.partitionBy(*_OUTCOME)
    rank = F.row_number().over(same.orderBy(F.col("orphan_id").isNotNull(), "orphan_id"))
    ours = ours.withColumn("n", rank).withColumn("owned", F.coalesce(F.max(F.when(own, F.col("is_closing"))).over(outcome), F.lit(False)))
    # without a closing of its own the outcome takes that of its first orphan; the row that stays at that instant carries it
    first = F.min(F.when(~own & F.col("is_closing"), F.struct("orphan_id", "captured_at"))).over(outcome)
    ours = ours.withColumn("taken", F.when(~F.col("owned"), first))
    closing = F.when(F.col("owned"), F.col("is_closing") & own).otherwise(F.coalesce(F.col("captured_at") == F.col("taken.captured_at"), F.lit(False)))
    kept = ours.where("n = 1").withColumn("is_closing", closing).select(*snapshots.columns)
    demoted = ~own & F.col("is_closing") & (F.col("owned") | ~F.coalesce(F.col("orphan_id") == F.col("taken.orphan_id"), F.lit(True)))
    promoted = ~own & F.col("is_closing") & (F.col("n") > 1) & ~F.col("owned") & F.coalesce(F.col("orphan_id") == F.col("taken.orphan_id"), F.lit(False))
    counts = ours.where(~own).groupBy("orphan_id").agg(F.count_if(demoted).alias("demoted"), F.count_if(promoted).alias("promoted"), F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("n") == 1).alias("repointed"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("demoted", "promoted", "duplicates", "repointed")]
    report = todo.join(counts, "orphan_id", "left").select("orphan_id", F.col("to_id").alias("event_id"), *zero)
    left = events.join(moves.select("event_id"), "event_id", "left_anti")
    if hand_over and "odds_id" in todo.columns:
        ids = todo.groupBy(F.col("to_id").alias("event_id")).agg(F.max_by("odds_id", "orphan_id").alias("__id"))
        left = left.join(ids, "event_id", "left").withColumn("odds_id", F.coalesce("__id", "odds_id")).select(*events.columns)
    return left, kept.unionByName(quiet), report


def summary(found: DataFrame, report: DataFrame, dry_run: bool = False, sample: int = 20) -> dict:
    """What a run did, or would do: counts, and bounded samples of orphans that were left."""
    by = {r[0]: r[1] for r in found.groupBy("state").count().collect()}
    sums = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("demoted", "promoted", "duplicates", "repointed")], F.count(F.lit(1)).alias("events_deleted")).first().asDict()
    skipped = {s: [r[0] for r in found.where(F.col("state") == s).select("orphan_id").orderBy("orphan_id").limit(sample).collect()] for s in (ALONE, AMBIGUOUS)}
    return {"job": "repair_orphan_events", "dry_run": dry_run, "orphans_found": sum(by.values()), "repointable": by.get(REPAIRABLE, 0), **sums, **{f"skipped_{k}": v for k, v in skipped.items()}}
