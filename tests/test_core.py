"""Golden values, tie rules and NULL policy of the core operators."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import metrics, pricing
from tidemark.operators import asof, audit, histories, identity
from tidemark.plans import features as X
from tidemark.plans.registry import exact_rounds
from tidemark.sources import feeds, tables

DAY = asof.MICROS_PER_DAY


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_pricing_goldens(spark):
    f = F.lit
    r = one(
        spark, a=pricing.american_to_decimal(f(-150)), b=pricing.american_to_decimal(f(130)), c=pricing.american_to_decimal(f(99)), v=pricing.no_vig_two_way(f(1.6666667), f(2.30)), arb=pricing.no_vig_two_way(f(2.1), f(2.1)),
        ev=pricing.ev_per_unit(f(0.55), f(2.0)), edge=pricing.edge(f(0.60), f(0.5798319)), k=pricing.kelly_fraction(f(0.62), f(2.0)), k2=pricing.kelly_fraction(f(0.45), f(2.30)), k3=pricing.kelly_fraction(f(0.3), f(2.0)),
        s=pricing.stake(f(1000.0), f(0.24)), s2=pricing.stake(f(1000.0), f(0.08)), am=pricing.decimal_to_american(f(2.30)), am2=pricing.decimal_to_american(f(1.86)), one=pricing.implied_prob(f(1.0)),
        eq=pricing.beat_close(f(2.0), f(2.0)), up=pricing.beat_close(f(2.1), f(2.0)), lost=pricing.settled_profit(f("lost"), f(2.0)))
    assert r.a == pytest.approx(5 / 3) and r.b == pytest.approx(2.3) and r.c is None
    assert (r.v.p_a, r.v.p_b, r.v.overround) == pytest.approx((0.5798319, 0.4201681, 1.0347826), abs=1e-6)
    assert r.arb.p_a is None and r.arb.overround is None and r.one is None
    assert (r.ev, r.edge, r.k, r.k2, r.k3, r.s, r.s2) == pytest.approx((0.10, 0.0201681, 0.24, 0.0269231, 0, 20, 10), abs=1e-6)
    assert r.am == pytest.approx(130) and round(r.am2) == -116 and r.eq is False and r.up is True and r.lost == -1
    with pytest.raises(Exception, match="above 1"):
        one(spark, x=pricing.implied_prob(F.lit(0.9), strict=True))


def test_metrics_goldens(spark):
    two = spark.createDataFrame([(1.0, 0.8), (0.0, 0.2)], "y double, p double")
    r = two.agg(metrics.log_loss().alias("l"), metrics.brier().alias("b")).first()
    assert r.l == pytest.approx(0.223144, abs=1e-5) and r.b == pytest.approx(0.04)
    good = spark.createDataFrame([(float(i < 75), 0.75) for i in range(100)] , "y double, p double")
    bad = spark.createDataFrame([(float(i < 50), 0.9) for i in range(100)], "y double, p double")
    assert metrics.report(good).first().ece == 0 and metrics.report(bad).first().ece == pytest.approx(0.4)
    assert one(spark, b=metrics.bucket(F.lit(1.0)), z=metrics.bucket(F.lit(0.0))) == (9, 0)
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    assert metrics.medians(nulls, ["a", "b"]) == {"a": 0.0, "b": 2.0}


def test_asof_primitives_against_brute_force(spark):
    rng = random.Random(1)
    history = [(rng.choice("ab"), rng.randint(0, 12), i, rng.choice([None, 1, 2, 3])) for i in range(60)]
    targets = [(i, rng.choice("abc"), rng.randint(0, 14)) for i in range(40)]
    h = spark.createDataFrame(history, "k string, ht long, id long, v long").repartition(3)
    t = spark.createDataFrame(targets, "tid long, k string, t long").repartition(2)
    for strict in (False, True):
        got = {r.tid: (r.id, r.v) for r in asof.latest(t, h, ["k"], "t", "ht", ["id", "v"], ["id"], strict).collect()}
        for tid, k, at in targets:
            best = max(((x[1], x[2], x[3]) for x in history if x[0] == k and (x[1] < at or x[1] == at and not strict)), default=(None, None, None), key=lambda x: (x[0], x[1]))
            assert got[tid] == best[1:]
    sums = {r.tid: r for r in asof.sums_before(t, h, ["k"], "t", "ht", {"w": (-3, -1)}, {"v": F.col("v"), "n": F.lit(1)}).collect()}
    recent = {r.tid: [x["id"] for x in r.recent] for r in asof.last_n(t, h, ["k"], "t", "ht", 3, ["id"], ["id"]).collect()}
    near = {r.tid: r.id for r in asof.nearest(t, h, ["k"], "t", "ht", 2, ["id"], ["id"]).collect()}
    snap = {}
    for r in asof.latest_set(h.select("k", "ht", "id"), t, ["k"], "t", "ht", ["id"]).collect():
        snap.setdefault(r.tid, set()).add(r.id)
    for tid, k, at in targets:
        own = [x for x in history if x[0] == k]
        win = [x for x in own if at - 3 <= x[1] <= at - 1]
        assert (sums[tid].n_w or 0) == len(win) and (sums[tid].v_w or 0) == sum(x[3] or 0 for x in win)
        assert recent[tid] == [x[2] for x in sorted((x for x in own if x[1] < at), key=lambda x: (x[1], x[2]), reverse=True)][:3]
        close = min(((abs(x[1] - at), x[1], x[2]) for x in own if abs(x[1] - at) <= 2), default=(0, 0, None))
        assert near[tid] == close[2]
        last = max((x[1] for x in own if x[1] <= at), default=None)
        assert snap.get(tid, set()) == {x[2] for x in own if x[1] == last}


def test_rolling_form_golden(spark):
    def day(m, d):
        return {6: 151, 7: 181}[m] + d

    games = [(1, day(7, 5), "H", "X", 5, 3, 3, 1), (2, day(7, 6), "X", "H", 7, 2, 4, 0), (3, day(6, 5), "H", "X", 1, 0, 0, 0), (4, day(7, 9), "H", "X", 10, 0, 8, 0), (5, day(7, 4), "A", "X", 2, 6, 1, 2)]
    rows = []
    for e, d, home, away, hs, as_, f5h, f5a in games:
        rows += [(e, d * DAY, d, "final", True, home, away, hs, as_, f5h, f5a), (e, d * DAY, d, "final", False, away, home, as_, hs, f5a, f5h)]
    rows += [(10, day(7, 8) * DAY - 3600, day(7, 8), "scheduled", True, "H", "A", None, None, None, None), (10, day(7, 8) * DAY - 3600, day(7, 8), "scheduled", False, "A", "H", None, None, None, None)]
    sides = spark.createDataFrame(rows, "event_id long, start_us long, start_day long, status string, is_home boolean, team string, opponent string, scored long, allowed long, f5_scored long, f5_allowed long")
    by = {(r.event_id, r.team): r for r in X.rolling_form(sides).collect()}
    h, a = by[10, "H"], by[10, "A"]
    assert (h.games_30d, h.win_pct_30d, h.runs_pg_30d, h.runs_allowed_pg_30d, h.f5_games_30d, h.f5_runs_pg_30d, h.f5_runs_allowed_pg_30d, h.rest_days, h.games_last_7d) == (2, 0.5, 3.5, 5.0, 2, 1.5, 2.5, 2, 2)
    assert (a.games_30d, a.win_pct_30d, a.runs_pg_30d, a.runs_allowed_pg_30d, a.rest_days, a.games_last_7d) == (1, 0, 2.0, 6.0, 4, 1)
    first = by[3, "H"]
    assert first.games_30d == 0 and first.win_pct_30d is None and first.rest_days is None


def test_availability(spark):
    said = lambda t, d: one(spark, e=X.il_effect(F.lit(t), F.lit(d)), m=X.mentions_il(F.lit(t), F.lit(d)))
    assert said("Status Change", "placed P on the 10-day injured list") == (1, False)
    assert said("Status Change", "ACTIVATED P from the disabled list; was placed") == (-1, False)
    assert said("Status Change", "P remains on the injured list") == (None, True)
    assert said("Trade", "sent to the minors") == (None, False)
    moves = spark.createDataFrame([("p", 10, 1, 1), ("p", 12, 3, -1), ("p", 12, 2, 1), ("q", 9, None, 1), ("q", 9, 5, -1)], "player_id string, at_day long, txn_id long, effect int")
    t = spark.createDataFrame([("p", 10), ("p", 11), ("p", 12), ("p", 13), ("q", 10), ("z", 10)], "player_id string, start_day long")
    got = {(r.player_id, r.start_day): r.is_out for r in X.out_as_of(t, moves).collect()}
    assert got == {("p", 10): False, ("p", 11): True, ("p", 12): True, ("p", 13): False, ("q", 10): False, ("z", 10): False}


def test_lineup_math(spark):
    b = spark.createDataFrame([(1, 7, True, 1, 0.4, 0.3), (1, 7, True, 2, None, None), (1, 7, True, 5, 0.2, 0.9)], "event_id long, team long, is_home boolean, slot int, batter_woba double, batter_vs_hand double")
    r = X.lineup(b).first()
    s = X.SLOT_SHARES
    assert r.lineup_woba_proj == pytest.approx((s[0] * 0.4 + s[4] * 0.2) / (s[0] + s[4]), abs=1e-4) and r.top4_woba_vs_hand == 0.3


def test_gaps(spark):
    h, m = 60, 1
    start = {"clean": 23 * h, "one": 23 * h, "none": 23 * h, "late": 23 * h}
    caps = [("clean", 15 * h + 23), ("clean", 18 * h + 23), ("clean", 21 * h + 23), ("clean", 21 * h + 23), ("one", 15 * h + 23), ("one", 21 * h + 23), ("late", 21 * h + 23), ("none", 2 * h), ("clean", 2 * h)]
    e = spark.createDataFrame(list(start.items()), "event_id string, start long")
    c = spark.createDataFrame(caps, "event_id string, at long")
    got = sorted((r.event_id, r["from"], r.to) for r in audit.gaps(e, c, ["event_id"], "start", "at", 10 * h, 4 * h * m).collect())
    assert got == [("none", 13 * h, 23 * h), ("one", 15 * h + 23, 21 * h + 23)]
    assert audit.is_red(0, 0, 0) is False and all(audit.is_red(*x) for x in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))


def test_identity_tiers(spark):
    m = 60_000_000
    events = spark.createDataFrame([(1, "H", "A", 0, "x1"), (2, "H", "B", 0, "gone"), (3, "H", "C", 0, None), (4, "H", "D", 0, "old1"), (5, "H", "D", 0, "old2"), (6, "H", "C", 100 * m, None)], "event_id long, home string, away string, start_us long, odds_id string")
    feed = spark.createDataFrame([("x1", "H", "A", 0), ("n2", "H", "B", m), ("n3", "H", "C", 29 * m), ("n3b", "H", "C", 30 * m), ("n4", "H", "D", 0), ("n5", "H", "Z", 0), ("n6", "H", "C", 600 * m)], "feed_id string, home string, away string, start_us long")
    got = {r.feed_id: (r.event_id, r.action) for r in identity.resolve(feed, events).collect()}
    assert got == {"x1": (1, "matched"), "n2": (2, "restamped"), "n3": (3, "merged"), "n3b": (6, "merged"), "n4": (None, "created_ambiguous"), "n5": (None, "created"), "n6": (None, "created")}
    snaps = spark.createDataFrame([(1, "b", "m", "home", 1, 1.9, True), (9, "b", "m", "home", 1, 1.9, True), (9, "b", "m", "home", 2, 1.8, True), (9, "b", "m", "away", 2, 2.0, True), (5, "b", "m", "away", 2, 2.0, False)], "event_id long, book string, market string, side string, captured_at long, price double, is_closing boolean")
    pairs = spark.createDataFrame([(9, 1)], "orphan_id long, event_id long")
    rows, report = identity.repaired(snaps, pairs)
    assert sorted(map(tuple, rows.collect())) == [(1, "b", "m", "away", 2, 2.0, True), (1, "b", "m", "home", 1, 1.9, True), (1, "b", "m", "home", 2, 1.8, False), (5, "b", "m", "away", 2, 2.0, False)]
    assert tuple(report.first()) == (2, 1)
    again, second = identity.repaired(rows, pairs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect())) and tuple(second.first()) == (0, 0)


def test_writers(spark):
    old = spark.createDataFrame([(1, "a", "L"), (2, "b", None)], "k long, name string, hand string")
    batch = spark.createDataFrame([(1, "A", None, 1), (1, "AA", None, 2), (3, "c", "R", 1)], "k long, name string, hand string, n long")
    assert sorted(map(tuple, tables.latest_wins(old, batch, ["k"], [F.desc("n")], ["hand"]).collect())) == [(1, "AA", "L"), (2, "b", None), (3, "c", "R")]
    assert sorted(map(tuple, tables.insert_ignore(old, batch.drop("n"), ["k"]).collect())) == [(3, "c", "R")]
    notes = []
    assert tables.read_or_empty(spark, "/nowhere", "players", notes).count() == 0 and notes
    h = spark.createDataFrame([("e", "X", 1), ("e", "Y", 2)], "event_id string, v string, at long")
    new = lambda v: spark.createDataFrame([("e", v)], "event_id string, v string")
    assert histories.appended(h, new("X"), ["event_id"], "v", "at").count() == 1 and histories.appended(h, new("Y"), ["event_id"], "v", "at").count() == 0
    assert one(spark, d=histories.display_name(F.lit("big_book"))).d == "Big Book"


def test_quality_rules(spark):
    df = spark.createDataFrame([("won", 1.0), ("won", -1.0), ("push", 0.5), (None, 1.0)], "result string, profit_units double")
    got = [r.violations for r in schemas.checked(df, schemas.RULES["pick_results"]).collect()]
    assert got == [[], ["won"], ["even"], []]
    with pytest.raises(Exception, match="violated: won"):
        schemas.enforced(df.where("profit_units < 0"), schemas.RULES["pick_results"]).collect()
    for name, ddl in schemas.ENTITIES.items():
        empty = spark.createDataFrame([], ddl)
        assert schemas.checked(empty, schemas.RULES.get(name, {})).count() == 0


def _payload(spark, value, **more):
    return spark.createDataFrame([(*more.values(), json.dumps(value))], [*more, "json"])


def test_feeds(spark):
    outcome = lambda n, p: {"name": n, "price": p}
    odds = {"id": "e", "home_team": "H", "away_team": "A", "commence_time": "2026-07-08T23:00:00Z", "bookmakers": [{"key": "fanduel", "markets": [{"key": "h2h", "outcomes": [outcome("H", 2.05), outcome("A", 1.86)]}, {"key": "spreads", "outcomes": [outcome("H", 1.9)]}]}, {"key": "pinnacle", "markets": [{"key": "h2h_1st_5_innings", "outcomes": [outcome("Draw", 5.0), outcome("A", 1.0)]}]}]}
    rows, skipped = feeds.odds(_payload(spark, odds))
    assert sorted((r.book, r.market, r.side, r.price_american) for r in rows.collect()) == [("fanduel", "moneyline", "away", -116), ("fanduel", "moneyline", "home", 105)]
    assert sorted(r.reason for r in skipped.collect()) == ["fanduel:market:spreads", "pinnacle:f5_moneyline:away:price:1.0", "pinnacle:f5_moneyline:outcome:Draw"]

    def player(i, order=None, bat=None, pit=None, hand="R"):
        return {"person": {"id": i, "fullName": f"N{i}", "pitchHand": {"code": hand}} if i else {}, "battingOrder": order, "stats": {"batting": bat, "pitching": pit}}

    bat = {"atBats": 4, "hits": 2, "strikeOuts": 1, "baseOnBalls": 0}
    pit = {"outs": None, "inningsPitched": "5.2", "battersFaced": 20, "strikeOuts": 5, "baseOnBalls": 1}
    box = {"teams": {
        "home": {"pitchers": [2, 1], "players": {"ID1": player(1, "100", bat, pit), "ID2": player(2, "101", bat | {"hits": 5}, pit | {"outs": 3}), "ID3": player(3, "200", bat | {"atBats": 0, "hits": 0}), "ID4": player(4, "200", {"hits": 1}), "ID0": player(None, "300", bat)}},
        "away": {"pitchers": [8, 9], "players": {"ID8": player(8, "x", {"atBats": 0, "hits": 0, "strikeOuts": 0, "baseOnBalls": 0}, pit | {"gamesStarted": 1}, "Q"), "ID9": player(9, None, None, pit | {"gamesStarted": 1, "battersFaced": None})}}}}
    p = _payload(spark, box, game=7)
    rows, left = feeds.batting(p)
    assert [(r.person, r.batting_order) for r in rows.collect()] == [(1, 100)]
    assert sorted((r.side, r.person or 0, r.reason) for r in left.collect()) == [("away", 0, "no_batting_lines_kept"), ("away", 8, "zero_pa"), ("home", 0, "batting_line_without_person_id"), ("home", 2, "batting_inconsistent"), ("home", 3, "zero_pa"), ("home", 4, "batting_missing:atBats,strikeOuts,baseOnBalls")]
    rows, left = feeds.pitching(p)
    assert sorted((r.person, r.is_starter, r.outs_recorded, r.hand) for r in rows.collect()) == [(1, False, 17, "R"), (2, True, 3, "R"), (8, True, 17, None)]
    assert sorted(r.reason for r in left.collect()) == ["missing:battersFaced", "starter_count:2", "starter_from_appearance_order:2"]
    rows, left = feeds.lineups(p)
    assert sorted((r.person, r.batting_order) for r in rows.collect()) == [(1, 100), (3, 200)]
    assert sorted(r.reason for r in left.collect()) == ["duplicate_slot:200", "lineup_slot_without_person_id:300", "partial_lineup:2"]


def test_exact_rounds():
    assert exact_rounds("a + round(x, 2)") == "a + CAST(round(CAST(x AS DECIMAL(28,12)), 2) AS DOUBLE)"
    assert exact_rounds("round(round(f(a, b)), 4)") == "CAST(round(CAST(round(f(a, b)) AS DECIMAL(28,12)), 4) AS DOUBLE)"


def test_stream_and_closing(spark, tmp_path):
    from tidemark.streaming import capture

    rows = [("e", "b", "m", "home", 2.0, 105, f"2026-01-01T0{h}:00:00Z", False) for h in (1, 2, 2, 3)]
    df = spark.createDataFrame(rows, "event_id string, book_id string, market string, side string, price_decimal double, price_american int, captured_at string, is_closing boolean")
    df.write.json(str(tmp_path / "in"))
    stream = capture.deduplicated(capture.source(spark, str(tmp_path / "in")))
    capture.append(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3
    starts = spark.createDataFrame([("e", "2026-01-01 03:00:00")], "event_id string, start string").withColumn("start", F.col("start").cast("timestamp"))
    assert capture.closing(out, starts).select(F.hour("captured_at")).first()[0] == 2
    bars = capture.bars(stream)
    assert bars.isStreaming


def test_entry_without_llm():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 60
    assert all(len(list(g)) == 1 for _, g in itertools.groupby(sorted(names)))


def test_players_out_follow_earlier_moves_only(spark):
    """A move on the day itself or later tells nothing; unknown before the archive's first move or without an established player."""
    from tidemark.plans import features as X

    bat = {"ab": 300, "d2": 0, "d3": 0, "bhr": 0, "ubb": 0, "ibb": 0, "so": 0, "bhbp": 0, "sf": 0, "sh": 0}
    lines = spark.createDataFrame([{"team": 1, "player_id": p, "start_day": 100, "h": h, **bat, "ab": ab} for p, h, ab in ((1, 90, 300), (2, 80, 300), (3, 70, 300), (4, 50, 60))])
    moves = spark.createDataFrame([(1, 99, 9, -1), (2, 110, 7, -1), (2, 110, 8, 1), (1, 120, 10, 1), (3, 101, 11, 1)], "player_id long, at_day long, txn_id long, effect int")
    targets = spark.createDataFrame([(d, 1, True, d) for d in (100, 101, 110, 111, 120, 121, 465, 466)] + [(7, 2, False, 111)], "event_id long, team long, is_home boolean, start_day long")
    got = {r.event_id: r.star_out_flag for r in X.star_out(targets, lines, moves).collect()}
    assert got == {100: None, 101: 0, 110: 0, 111: 1, 120: 1, 121: 2, 465: 2, 466: None, 7: None}
    pen = spark.createDataFrame([(1, p, 100, outs, 10 * outs, k, 1, 0, 1, 3, None) for p, outs, k in ((1, 12, 9), (2, 9, 6), (3, 8, 8), (5, 30, 2), (6, 30, 1))], "team long, player_id long, start_day long, outs long, bf long, k long, bb long, hbp long, hr long, fly long, sac long")
    got = {r.event_id: r.bullpen_il_depletion for r in X.bullpen_out(targets.where("start_day < 140"), pen, moves).collect()}
    assert got == {100: None, 101: 0, 110: 0, 111: 1, 120: 1, 121: 2, 7: None}


def test_market_prior_of_the_last_pair_before_the_start(spark):
    """F32: captures after the start and soft books don't count; a last pair without a margin leaves none."""
    from tidemark.plans import features as X

    rows = [(1, "b", "home", 1.9, 10, True), (1, "b", "away", 1.9, 10, True), (1, "a", "home", 1.5, 10, True), (1, "a", "away", 2.5, 10, True), (1, "a", "home", 1.1, 12, True), (1, "a", "away", 9.0, 30, True), (1, "s", "home", 1.2, 11, False), (1, "s", "away", 3.0, 11, False)]
    rows += [(2, "a", "home", 1.9, 5, True), (2, "a", "away", 1.9, 5, True), (2, "a", "home", 2.5, 6, True), (2, "a", "away", 2.5, 6, True)]
    odds = spark.createDataFrame(rows, "event_id long, book string, side string, price double, captured long, is_sharp boolean")
    got = [tuple(r) for r in X.market_prior(odds, spark.createDataFrame([(1, 20), (2, 20)], "event_id long, start long")).collect()]
    assert got == [(1, 10, "a", 0.625)]
