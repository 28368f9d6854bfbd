"""Identity: sessions, one-to-one choices, the batch and the streaming resolver against plain versions; upserts that touch few files."""

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.sources import landing, tables
from tidemark.streaming import resolver

M = 60_000_000
H = 60 * M
FEED, EVENTS = "feed_id string, home string, away string, start_us long", "event_id string, home string, away string, start_us long, odds_id string"


def plain_cycle(feed, events, live=None, captured=None, stamped=None, former=None):
    """One row at a time against a dict of events {id: [home, away, start, odds id]}, as a writer with one connection would."""
    events = {k: list(v) for k, v in events.items()}
    stamped, former = dict(stamped or {}), {k: list(v) for k, v in (former or {}).items()}
    live = {f[0] for f in feed} if live is None else live
    out = {}
    for i, h, a, t in feed:
        if i in out:
            continue
        same = [k for k, v in sorted(events.items()) if v[3] == i] or [k for k, x in sorted(former.items()) if i in x]
        if same:
            out[i] = (same[0], "matched")
            continue
        pair = [(abs(v[2] - t), k) for k, v in sorted(events.items()) if (v[0], v[1]) == (h, a)]
        old = [k for d, k in pair if d <= identity.RESTAMP_US and events[k][3] is not None and events[k][3] not in live and (captured is None or stamped.get(k) is None or stamped[k] <= captured)]
        free = sorted((d, k) for d, k in pair if d <= identity.MERGE_US and events[k][3] is None)
        if len(old) == 1 or free:
            k, action = (old[0], "restamped") if len(old) == 1 else (free[0][1], "merged")
            if events[k][3]:
                former.setdefault(k, []).append(events[k][3])
            events[k][3] = i
        else:
            k, action = f"odds:{i}", "created_ambiguous" if old else "created"
            events[k] = [h, a, t, i]
        stamped[k] = captured
        out[i] = (k, action)
    return out, events, stamped, former


def world(seed, pairs=6, n=80, dense=False):
    rng = random.Random(seed)
    at = lambda: rng.randint(0, 30 if dense else 400) * rng.choice((M, 10 * M, H))
    events = {f"e{k:03}": [f"H{rng.randrange(pairs)}", f"A{rng.randrange(2)}", at(), rng.choice((None, f"f{k}", f"gone{k}"))] for k in range(n)}
    feed = [(f"f{k}", *rng.choice(list(events.values()))[:2], at() + rng.choice((0, M, -M))) for k in range(0, 2 * n)]
    return feed, events


@pytest.mark.parametrize("seed, dense", [(1, False), (2, True), (3, True)])
def test_resolve_in_turn(spark, seed, dense):
    feed, events = world(seed, dense=dense)
    feed.sort(key=lambda f: (f[3], f[0]))
    got = identity.resolve(spark.createDataFrame(feed, FEED), spark.createDataFrame([(k, *v) for k, v in events.items()], EVENTS)).collect()
    want, _, _, _ = plain_cycle(feed, events)
    assert {r.feed_id: (r.event_id, r.action) for r in got} == {k: (None if a.startswith("created") else e, a) for k, (e, a) in want.items()}
    assert {a for _, a in want.values()} >= {"matched", "restamped", "merged", "created"}


@pytest.mark.parametrize("seed", [4, 5])
def test_assign_nearest_first(spark, seed):
    feed, events = world(seed, dense=seed == 5)
    free = [(k, *v[:3]) for k, v in events.items()]
    pairs = sorted((abs(s - t), f, e) for f, h, a, t in feed for e, h2, a2, s in free if (h, a) == (h2, a2) and abs(s - t) <= 3 * H)
    want, taken = {}, set()
    for _, f, e in pairs:
        if f not in want and e not in taken:
            want[f] = e
            taken.add(e)
    got = identity.assign(spark.createDataFrame(feed, FEED), spark.createDataFrame(free, "event_id string, home string, away string, s long"), 3 * H)
    assert {r.feed_id: r.event_id for r in got.collect()} == want and len(want) > 20


def test_sessions_are_cut_where_no_pair_spans(spark, monkeypatch):
    monkeypatch.setattr(identity, "CELL_REACH", 3)  # many cells
    rng = random.Random(8)
    rows = [(rng.randrange(3), rng.randint(0, 3000), rng.random() < 0.5) for _ in range(500)]
    within = 7
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, key long, at long, kind boolean")
    got = {r.n: r.session for r in identity.sessions(df, ("key",), "at", "kind", within).collect()}
    assert len(got) == len(rows)
    want = {}
    for key in range(3):
        own = sorted((at, n, kind) for n, (k, at, kind) in enumerate(rows) if k == key)
        session = None
        for at, n, _ in own:
            spans = any(a < at <= b and b - a <= within and x != y for a, _, x in own for b, _, y in own)
            if not spans:
                session = at
            want[n] = session
    assert got == want
    # a team that plays every day for a century: sessions stay as small as a day's candidates
    daily = spark.range(36_500).select(F.lit("H").alias("home"), F.lit("A").alias("away"), (F.col("id") * 24 * H).alias("at"), (F.col("id") % 2 == 0).alias("kind"))
    monkeypatch.setattr(identity, "CELL_REACH", 64)
    sizes = identity.sessions(daily.union(daily), ("home", "away"), "at", "kind", 3 * H).groupBy("session").count().agg(F.max("count")).first()[0]
    assert sizes == 2


def test_identity_takes_empty_and_null(spark):
    feed, events = spark.createDataFrame([("x", None, "A", 0), ("y", "H", "A", None)], FEED), spark.createDataFrame([("e", None, "A", 0, None), ("f", "H", "A", 0, None)], EVENTS)
    got = {r.feed_id: r.action for r in identity.resolve(feed, events.where("event_id = 'none'")).collect()}
    assert got == {"x": "created", "y": "created"}
    assert identity.resolve(feed.where("feed_id = 'none'"), events).count() == 0


# -- stored tables


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ks, v: spark.createDataFrame([(k, v, None if v == "new" else "L") for k in ks], "k long, v string, hand string")
    assert tables.upsert(path, rows(range(200), "old"), ["k"], ["v"], buckets=16) == {"inserted": 200, "updated": 0, "unchanged": 0}
    before = files(path)
    assert tables.upsert(path, rows(range(200), "old"), ["k"], ["v"], buckets=16) == {"inserted": 0, "updated": 0, "unchanged": 200} and files(path) == before
    assert tables.upsert(path, rows([7, 1000], "new"), ["k"], ["v"], keep_old=["hand"], buckets=16) == {"inserted": 1, "updated": 1, "unchanged": 0}
    after = files(path)
    assert len(set(before) & set(after)) >= len(before) - 2 and set(before) != set(after)
    got = {r.k: (r.v, r.hand) for r in spark.read.parquet(path).collect()}
    assert len(got) == 201 and got[7] == ("new", "L") and got[1000] == ("new", None) and got[8] == ("old", "L")
    # a batch with several rows of a key; one that broke off after it was staged is finished by the next one
    twice = spark.createDataFrame([(1, "b", "R"), (1, "a", "R")], "k long, v string, hand string")
    tables.upsert(path, twice, ["k"], [F.desc("v")], buckets=16)
    assert spark.read.parquet(path).where("k = 1").first().v == "b"
    bucket = spark.read.parquet(path).where("k = 1").first().bucket_16
    spark.read.parquet(path).where(F.col("bucket_16") == bucket).withColumn("v", F.lit("staged")).write.partitionBy("bucket_16").parquet(f"{path}.staged")
    assert tables.upsert(path, twice.limit(0), ["k"], ["v"], buckets=16) == {"inserted": 0, "updated": 0, "unchanged": 0}
    assert spark.read.parquet(path).where("k = 1").first().v == "staged" and spark.read.parquet(path).count() == 201 and not os.path.exists(f"{path}.staged")


# -- stream


def payload(i, home, away, start_us, price=1.9):
    start = datetime.fromtimestamp(start_us / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"id": i, "home_team": home, "away_team": away, "commence_time": start, "bookmakers": [{"key": "b", "markets": [{"key": "h2h", "outcomes": [{"name": home, "price": price}, {"name": away, "price": 2.1}]}]}]}


DAY0 = 1_784_332_800_000_000  # 2026-07-18


def captured(us):
    return datetime.fromtimestamp(us / 1e6, timezone.utc)


def stream_tables(spark, root):
    events = {r.event_id: (r.home, r.away, r.start_us, r.odds_id, r.stamped_us, sorted(r.former_ids or [])) for r in resolver.table(spark, root, "events").collect()}
    prices = sorted(map(tuple, resolver.table(spark, root, "prices").collect()))
    decisions = sorted((r.captured_us, r.feed_id, r.event_id, r.action) for r in resolver.table(spark, root, "decisions").collect())
    return events, prices, decisions


def test_stream_equals_one_writer(spark, tmp_path):
    """Captures land, one is late, the query starts anew in between, one batch comes twice: the tables are those of a writer that takes row by row."""
    rng = random.Random(6)
    folder, root = str(tmp_path / "landing"), str(tmp_path / "root")
    games = [(f"g{k}", f"H{rng.randrange(3)}", f"A{rng.randrange(2)}", DAY0 + 20 * H + rng.randrange(30) * 10 * M) for k in range(14)]
    resolver.seed(spark.createDataFrame([g for g in games if rng.random() < 0.7], "event_id string, home string, away string, start_us long"), root)
    events = {r.event_id: [r.home, r.away, r.start_us, r.odds_id] for r in resolver.table(spark, root, "events").collect()}
    stamped, former = {}, {}
    plan = [DAY0 + 6 * H, DAY0 + 12 * H, DAY0 + 9 * H, DAY0 + 15 * H]  # the third is late
    log, prices, feeds_ = [], set(), {}
    for n, at in enumerate(plan):
        feed = [(f"{g}.{rng.choice((0, 0, n))}", h, a, t + rng.choice((0, 0, M))) for g, h, a, t in games if rng.random() < 0.8]
        feed += [feed[0]] if n == 1 else []  # listed twice
        feed.append((f"started{n}", "H0", "A0", at - H))
        feeds_[at] = feed
        due = [f for f in feed if f[3] > at]
        found, events, stamped, former = plain_cycle(due, events, {f[0] for f in feed}, at, stamped, former)
        log += [(at, f, e, a) for f, (e, a) in found.items()]
        prices |= {(found[f[0]][0], "b", "moneyline", s, at, p) for f in due for s, p in (("home", 1.9), ("away", 2.1))}
    for at in plan[:1]:
        landing.land_capture(spark, [payload(*f) for f in feeds_[at]], folder, captured(at))
    resolver.run(spark, folder, root).awaitTermination()
    for at in plan[1:3]:
        landing.land_capture(spark, [payload(*f) for f in feeds_[at]], folder, captured(at))
        resolver.run(spark, folder, root).awaitTermination()  # starts anew
    landing.land_capture(spark, [payload(*f) for f in feeds_[plan[3]]], folder, captured(plan[3]))
    resolver.run(spark, folder, root).awaitTermination()
    got = stream_tables(spark, root)
    assert got[2] == sorted(log)
    assert {k: (*v[:4],) for k, v in got[0].items()} == {k: tuple(v) for k, v in events.items()}
    assert {k: v[5] for k, v in got[0].items() if v[5]} == {k: sorted(set(v) - {events[k][3]}) for k, v in former.items() if set(v) - {events[k][3]}}
    assert {p[:6] for p in got[1]} == prices and len(got[1]) == len(prices)
    assert {a for *_, a in log} >= {"matched", "merged", "restamped", "created"}
    kept = files(f"{root}/events") + files(f"{root}/prices")
    batch = spark.read.schema(landing.CAPTURE).json(folder)
    resolver.take_batch(batch.where(F.unix_micros("captured_at").isin(plan[1], plan[3])), root)  # comes again
    assert stream_tables(spark, root) == got and files(f"{root}/events") + files(f"{root}/prices") == kept


def test_stream_finishes_what_broke_off(spark, tmp_path, monkeypatch):
    """A run that fails after the decisions are logged: the next one writes the same events and prices."""
    folder, root = str(tmp_path / "landing"), str(tmp_path / "root")
    resolver.seed(spark.createDataFrame([("g1", "H", "A", DAY0 + 20 * H), ("g2", "H", "A", DAY0 + 23 * H)], "event_id string, home string, away string, start_us long"), root)
    landing.land_capture(spark, [payload("x", "H", "A", DAY0 + 20 * H), payload("y", "H", "B", DAY0 + 20 * H)], folder, captured(DAY0))
    whole = tables.upsert

    def broken(path, *args, **more):
        if path.endswith("/events"):
            raise OSError("lost")
        return whole(path, *args, **more)

    monkeypatch.setattr(tables, "upsert", broken)
    with pytest.raises(Exception, match="lost"):
        resolver.run(spark, folder, root).awaitTermination()
    monkeypatch.setattr(tables, "upsert", whole)
    resolver.run(spark, folder, root).awaitTermination()
    events, prices, decisions = stream_tables(spark, root)
    assert {k: v[3] for k, v in events.items()} == {"g1": "x", "g2": None, "odds:y": "y"} and len(prices) == 4
    assert [d[1:] for d in decisions] == [("x", "g1", "merged"), ("y", "odds:y", "created")]
    assert json.dumps(decisions)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_stream_query_equals_one_writer(spark):
    from tidemark import plans
    from tidemark.plans import ingest_queries

    sf = "/root/testdata/sf0.001"
    scheduled, captures = ingest_queries.captures_of(spark, sf)
    events, stamped, former, prices = {r.event_id: [r.home, r.away, r.start_us, None] for r in scheduled.collect()}, {}, {}, {}
    for k, c in enumerate(captures):
        feed = []
        for r in c.orderBy("place").collect():
            p = json.loads(r.json)
            feed.append((p["id"], p["home_team"], p["away_team"], int(datetime.fromisoformat(p["commence_time"]).timestamp()) * 1_000_000))
        found, events, stamped, former = plain_cycle(feed, events, None, k, stamped, former)
        for e, _ in found.values():
            prices[e] = prices.get(e, 0) + 2
    got = {r.event_id: r for r in plans.QUERIES["u10_stream_resolver"](spark, sf).collect()}
    assert {k: (r.home, r.away, r.start_us, r.odds_id) for k, r in got.items()} == {k: tuple(v) for k, v in events.items()}
    assert {k: r.prices for k, r in got.items() if r.prices} == prices
    assert {k: r.former_ids for k, r in got.items() if r.former_ids} == {k: ",".join(sorted(set(v) - {events[k][3]})) for k, v in former.items() if set(v) - {events[k][3]}}
    assert any(k.startswith("odds:") for k in got) and former


def test_capture_of_many_files_is_taken_whole(spark, tmp_path):
    """Before, a capture had to be one file, and so was written by one task, whatever its size."""
    at = DAY0 + 6 * H
    games = [(f"g{k}", f"H{k % 3}", "A", DAY0 + 20 * H + k * H) for k in range(40)]
    one, many = ((str(tmp_path / n / "landing"), str(tmp_path / n / "root")) for n in ("one", "many"))
    for _, root in (one, many):
        resolver.seed(spark.createDataFrame(games[::2], "event_id string, home string, away string, start_us long"), root)
    landing.land_capture(spark, [payload(*g) for g in games], one[0], captured(at))
    rows = spark.createDataFrame([(k, json.dumps(payload(*g))) for k, g in enumerate(games)], "place long, json string").repartition(4)
    landing.land_whole(rows.limit(0), many[0], captured(at - H))  # a capture without payloads
    landing.land_whole(rows, many[0], captured(at))
    names = lambda folder: [f for _, _, fs in os.walk(folder) for f in fs if f.startswith("part-")]
    assert len(names(many[0])) == 2 and len(names(f"{many[0]}.parts")) >= 4
    for folder, root in (one, many):
        resolver.run(spark, folder, root).awaitTermination()
    got = stream_tables(spark, many[1])
    assert got == stream_tables(spark, one[1]) and len(got[2]) == 40
    rows.write.json(f"{many[0]}.parts/later")  # parts that nothing names yet
    resolver.run(spark, many[0], many[1]).awaitTermination()
    assert stream_tables(spark, many[1]) == got


def test_large_bucket_is_written_by_many_tasks(spark, tmp_path):
    """Before, all rows of a bucket (such as a capture's prices) went to one task."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        rows = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        path = str(tmp_path / "t")
        assert tables.upsert(path, rows, ["k"], ["v"], bucket=F.lit(7))["inserted"] == 40_000
    finally:
        spark.conf.set(key, before)
    assert len(files(path)) > 1 and spark.read.parquet(path).agg(F.countDistinct("k", "v")).first()[0] == 40_000
    assert tables.upsert(path, rows.where("k < 9"), ["k"], ["v"], bucket=F.lit(7))["unchanged"] == 9
