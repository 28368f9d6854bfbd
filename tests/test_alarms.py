"""The gap alarm on a stream equals the audit of the whole archive, whatever the order, slices and restarts; alarms come before the start."""

import random

from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.streaming import alarms

M = 60_000_000
H = 60 * M
T0 = 1_784_332_800_000_000
WINDOW, LIMIT = 10 * H, 2 * H


def test_watch_tells_overdue_and_holes():
    w = alarms.Watch(10, 2, start=20)
    assert list(w.up_to(15)) == [] and w.next_time() == 20
    w.pending = [11, 12]
    assert list(w.up_to(14)) == [] and w.last == 12 and w.next_time() == 15
    assert list(w.up_to(15)) == [("overdue", 12, None)] and list(w.up_to(16)) == [] and w.next_time() == 20
    w.pending = [17]
    assert list(w.up_to(18)) == [("hole", 12, 17)] and not w.told
    assert list(w.up_to(25)) == [("hole", 17, 20)]
    assert list(alarms.Watch(10, 2, start=20).up_to(20)) == [("hole", 10, 20)]
    assert list(alarms.Watch(10, 2, pending=[1]).up_to(50)) == []


def test_alarms_equal_the_audit(spark, tmp_path):
    rng = random.Random(3)
    events = [(f"e{k}", T0 + rng.randint(12, 60) * H) for k in range(25)]
    captures = sorted({(e, s - rng.randint(-20, 700) * M) for e, s in events for _ in range(rng.choice((0, 1, 4, 9)))}, key=lambda c: c[1])
    captures += captures[:5]  # told twice
    e = spark.createDataFrame(events, "event_id string, start long")
    c = spark.createDataFrame(captures, "event_id string, at long")
    rows = alarms.listed(e, c, "start", "at", WINDOW)
    seen = [r.seen for r in rows.orderBy("seen").collect()]
    cuts = [seen[len(seen) * k // 4] for k in range(1, 4)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        part = rows
        part = part.where(F.col("seen") > cuts[k - 1]) if k else part
        part = part.where(F.col("seen") <= cuts[k]) if k < 3 else part
        if k < 3:  # some rows of the end of a slice come with the next one
            late = rows.where((F.col("seen") <= cuts[k]) & (F.col("seen") > cuts[k] - F.expr("interval 20 minutes")) & F.col("at_us").isNotNull())
            part = part.exceptAll(late)
        if k:
            was = rows.where((F.col("seen") <= cuts[k - 1]) & (F.col("seen") > cuts[k - 1] - F.expr("interval 20 minutes")) & F.col("at_us").isNotNull())
            part = part.union(was)
        part.coalesce(1).write.mode("append").json(folder)
        alarms.run(spark, folder, out, WINDOW, LIMIT, "30 minutes").awaitTermination()  # each time anew, on the state that was kept
    alarms.tick(spark, T0 + 1000 * H).coalesce(1).write.mode("append").json(folder)
    alarms.run(spark, folder, out, WINDOW, LIMIT, "30 minutes").awaitTermination()
    got = spark.read.parquet(out).collect()
    want = sorted((r.event_id, r["from"], r.to) for r in audit.gaps(e, c, ["event_id"], "start", "at", WINDOW, LIMIT).collect())
    assert sorted((r.event_id, r.from_us, r.to_us) for r in got if r.kind == "hole") == want and len(want) > 10
    told = {(r.event_id, r.from_us) for r in got if r.kind == "overdue"}
    assert told and told <= {(e, f) for e, f, _ in want}
    again = alarms.run(spark, folder, out, WINDOW, LIMIT, "30 minutes")
    again.awaitTermination()
    assert spark.read.parquet(out).count() == len(got)


def test_states_are_kept_by_bucket(spark, tmp_path):
    """Before, each event was a state and a call of its own in every batch and at every trigger."""
    events = [(f"e{k}", T0 + (20 + k % 7) * H) for k in range(60)]
    captures = [(e, s - k * H) for e, s in events for k in (9, 6, 5)] + [(None, T0)]
    e, c = spark.createDataFrame(events, "event_id string, start long"), spark.createDataFrame(captures, "event_id string, at long")
    rows = alarms.listed(e, c, "start", "at", WINDOW)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    held = []
    for more in (rows, alarms.tick(spark, T0 + 22 * H), alarms.tick(spark, T0 + 100 * H)):
        more.coalesce(1).write.mode("append").json(folder)
        found = alarms.gaps(alarms.source(spark, folder), WINDOW, LIMIT, "1 hour", buckets=4)
        query = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}.progress").trigger(availableNow=True).start()
        query.awaitTermination()
        held += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(held) <= 4
    got = sorted((r.event_id, r.from_us, r.to_us) for r in spark.read.parquet(out).where("kind = 'hole'").collect())
    assert got == sorted((r.event_id, r["from"], r.to) for r in audit.gaps(e, c, ["event_id"], "start", "at", WINDOW, LIMIT).collect()) and len(got) == 120
    w = {"a": alarms.Watch(1, 2, 9, 4, [5, 6], True), None: alarms.Watch(1, 2, pending=[3])}
    assert {k: vars(x) for k, x in alarms._watches(alarms._state(w), 1, 2).items()} == {k: vars(x) for k, x in w.items()}
