"""Jobs and landing: idempotent, degrade on failure, and say what they did."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.plans import jobs
from tidemark.sources import feeds, landing


def test_landing(spark, tmp_path):
    asked = []

    def fetch(path, params):
        asked.append((path, params))
        if "2026-02-15" in params.get("startDate", ""):
            raise OSError("down")
        return {"transactions": [{"id": 1, "person": {"id": 2}, "date": "2026-01-05", "typeDesc": "Status Change", "description": "placed on the injured list"}]}

    rows, failed = landing.fetched(fetch, "transactions", pause=0, start=date(2026, 1, 1), end=date(2026, 3, 1))
    assert [p["startDate"] for _, p in asked] == ["2026-01-01", "2026-02-15"] and len(rows) == 1 and failed == ["transactions: down"]
    landing.land(spark, rows, str(tmp_path / "in"))
    got, left = feeds.transactions(landing.landed(spark, str(tmp_path / "in")))
    assert got.count() == 1 and left.count() == 0
    assert list(landing.id_chunks([3, 1, 2, 3], 2)) == [[1, 2], [3]]
    kinds = {"schedule": {"day": date(2026, 1, 1)}, "schedule_range": {"start": date(2026, 1, 1), "end": date(2026, 1, 2)}, "boxscores": {"games": [1, 2]}, "people": {"ids": range(150)}, "odds": {"markets": "h2h", "regions": "us"}, "event_odds": {"events": ["a"], "markets": "h2h", "regions": "us"}}
    assert {k: len(landing.requests_for(k, **a)) for k, a in kinds.items()} == {"schedule": 1, "schedule_range": 1, "boxscores": 2, "people": 2, "odds": 1, "event_odds": 1}
    assert spark.range(1).select(landing.game_of(F.lit("game/77/boxscore"))).first()[0] == 77
    known = spark.createDataFrame([], got.withColumn("effect", F.lit(1)).schema)
    table, said = jobs.sync_transactions(landing.landed(spark, str(tmp_path / "in")), known)
    again, _ = jobs.sync_transactions(landing.landed(spark, str(tmp_path / "in")), table)
    assert said["placements"] == 1 and again.count() == table.count() == 1
    assert "| rows | 1 |" in jobs.markdown(said, "moves")


def test_odds_cycle(spark):
    event = {"id": "o1", "home_team": "H", "away_team": "A", "commence_time": "2026-07-08T23:00:00Z", "bookmakers": [{"key": "b", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 2.0}, {"name": "A", "price": 1.9}]}]}]}
    late = event | {"id": "o2", "home_team": "X", "commence_time": "2026-07-08T10:00:00Z"}
    payloads = spark.createDataFrame([(json.dumps(e),) for e in (event, late)], "json string")
    events = spark.createDataFrame([(1, "H", "A", 1783551600000000, None)], "event_id long, home string, away string, start_us long, odds_id string")
    none = spark.createDataFrame([], "event_id string, book string, market string, side string, captured_at timestamp")
    now = datetime(2026, 7, 8, 22, 50)
    rows, named, said = jobs.snapshot_odds(payloads, events, none, now)
    assert {(r.event_id, r.side, r.is_closing) for r in rows.collect()} == {("1", "home", True), ("1", "away", True)}
    assert said["actions"] == {"merged": 1, "created": 1} and said["rows"] == 2
    rows2, _, _ = jobs.snapshot_odds(payloads, events, rows.select(none.columns), now)
    assert rows2.count() == 0


def test_players_and_audit(spark):
    known = spark.createDataFrame([(1, "Real", "L"), (2, "person 2", None)], "person int, name string, hand string")
    lines = spark.createDataFrame([(1, "person 1", None), (2, "Two", "R"), (2, "person 2", None), (3, "person 3", None)], "person int, name string, hand string")
    assert sorted(map(tuple, jobs.players(lines, known).collect())) == [(1, "Real", "L"), (2, "Two", "R"), (3, "person 3", None)]
    events = spark.createDataFrame([("a", 36_000_000_000), ("b", 36_000_000_000), ("c", 360_000_000_000)], "event_id string, start long")
    caps = spark.createDataFrame([("a", 35_000_000_000), ("a", 20_000_000_000)], "event_id string, at long")
    none = spark.createDataFrame([], "event_id string")
    said = jobs.audit_archive(events, caps, none, 20_000_000_000, 10_000_000_000)
    assert (said["priced"], said["unpriced"], said["miss"], said["gapped"], said["red"]) == (1, 1, 1, 1, True)
    ids = spark.createDataFrame([("a", {"odds": "1"}), ("b", {"odds": "1", "schedule": "2"}), ("c", {})], "event_id string, external_ids map<string,string>")
    assert [r.event_id for r in jobs.orphan_events(ids).collect()] == ["a"]
    sides = jobs.analyse(spark, 2.0, 1.9, 0.6)
    assert [s["side"] for s in sides] == ["home", "away"] and sides[0]["publish"] is True and sides[1]["publish"] is False
    assert jobs.dimension(known.select(F.lit("x").alias("key")), spark.createDataFrame([("big_one",), ("x",)], "key string")).collect()[0].name == "Big One"


def test_last_listing_wins(spark):
    """A correction that lowers a score, an earlier start and an earlier date stand, in one payload and over payloads."""
    game = lambda start, score: {"gamePk": 7, "gameDate": start, "status": {"abstractGameState": "Final"}, "teams": {"home": {"score": score}, "away": {"score": 2}}}
    days = lambda *games: json.dumps({"dates": [{"games": [g]} for g in games]})
    one = spark.createDataFrame([(days(game("2026-05-02T20:00:00Z", 9), game("2026-05-01T20:00:00Z", 3)), 1)], "json string, at int")
    two = one.union(spark.createDataFrame([(days(game("2026-04-30T20:00:00Z", 1)), 2)], one.schema))
    events = spark.createDataFrame([], "game_pk bigint, start timestamp, status string")
    results = spark.createDataFrame([(7, 8, 8, None, None)], "game_pk bigint, home_score int, away_score int, f5_home_score int, f5_away_score int")
    for payloads, day, score in ((one, 1, 3), (two, 30, 1)):
        assert [r.start.day for r in jobs.sync_schedule(payloads, events, "at")[0].collect()] == [day]
        assert [r.home_score for r in jobs.backfill_results(payloads, results, "at")[0].collect()] == [score]
    move = lambda day: {"id": 1, "person": {"id": 2}, "date": day}
    moves = spark.createDataFrame([(json.dumps({"transactions": [move("2026-05-09"), move("2026-05-03")]}),)], "json string")
    known = feeds.transactions(moves)[0].withColumn("effect", F.lit(1)).limit(0)
    table, _ = jobs.sync_transactions(moves, known)
    assert [r.transaction_date for r in table.collect()] == [date(2026, 5, 3)]


def test_hands_and_guard(spark):
    from tidemark.operators import histories

    people = spark.createDataFrame([(json.dumps({"people": [{"id": 1, "fullName": "One", "pitchHand": {"code": "R"}}, {"id": 2}, {"fullName": "No id"}]}),)], "json string")
    known = spark.createDataFrame([(1, "person 1", None), (2, "Two", "L")], "person int, name string, hand string")
    assert sorted(map(tuple, jobs.hands(people, known).collect())) == [(1, "One", "R"), (2, "Two", "L")]
    kind = "pick_id int, status string, price double"
    old = spark.createDataFrame([(1, "pending", 1.0), (2, "won", 1.0), (3, "won", None), (4, "lost", 2.0), (5, "won", 1.0)], kind)
    new = spark.createDataFrame([(1, "won", 1.0), (2, "void", 1.0), (3, "won", None), (4, "lost", None), (6, "pending", 1.0)], kind)
    assert dict(map(tuple, histories.guarded(old, new, "pick_id").collect())) == {1: "ok", 2: "transition", 3: "ok", 4: "immutable", 5: "deleted", 6: "inserted"}
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "1"}), ({"a": "1"}, None)], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in maps.select(histories.merged_ids(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3"}, {"x": "1"}, {"a": "1"}]


def test_archive_days(spark):
    from tidemark.operators import audit

    day = 86_400_000_000
    events = spark.createDataFrame([("a", day + 10), ("b", day + 20), ("c", 3 * day)], "event_id string, start long")
    caps = spark.createDataFrame([("a", day), ("a", day + 10), ("b", day + 21), ("z", 5 * day)], "event_id string, at long")
    got = {r.day.isoformat(): tuple(r)[1:] for r in audit.days(events, caps, ["event_id"], "start", "at", 10).collect()}
    assert got == {"1970-01-02": (2, 1, 1, 3), "1970-01-04": (1, 0, 0, 0)}
