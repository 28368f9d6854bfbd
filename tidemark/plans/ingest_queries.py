"""Feeds, identity, histories, models and streams over the driver's tables.

Feed payloads are made from the tables as JSON text, parsed back, and held against the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.functions.metrics import rounded
from tidemark.ml import walkforward
from tidemark.operators import asof, histories, identity
from tidemark.plans import bindings as B
from tidemark.plans import features as X
from tidemark.plans import jobs, repair
from tidemark.plans.registry import query
from tidemark.plans.relational_queries import starts, table
from tidemark.plans.registry import ORACLE
from tidemark.session import adopt, cut, shared_dir, side_by_side
from tidemark.sources import feeds, landing
from tidemark.streaming import alarms, capture, resolver


def _json(df: DataFrame, column) -> DataFrame:
    return df.select(F.to_json(column).alias("json"))


@query(
    """WITH e AS (SELECT event_id, event_type, 'H' || user_id AS home, CASE event_id % 3 WHEN 0 THEN 'H' || user_id WHEN 1 THEN 'A' || user_id ELSE 'Draw' END AS name, (10000 + CAST(round(value * 100) AS BIGINT)) / 10000 AS price, event_id % 10 = 0 AS other FROM events)
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS book, CASE WHEN other THEN 'skipped' WHEN name = 'Draw' THEN 'skipped' WHEN price <= 1.001 THEN 'skipped' WHEN name = home THEN 'home' ELSE 'away' END AS side,
      CASE WHEN NOT other AND name <> 'Draw' AND price > 1.001 THEN round(price, 4) END AS price_decimal FROM e"""
)
def r1_odds_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, S6, S7, §2.9: a price feed parsed into outcomes and what was skipped; both united."""
    c = F.col
    e = table(spark, sf_dir, "events")
    name = F.when(c("event_id") % 3 == 0, F.concat(F.lit("H"), "user_id")).when(c("event_id") % 3 == 1, F.concat(F.lit("A"), "user_id")).otherwise("Draw")
    outcome = F.struct(name.alias("name"), ((10000 + F.round(c("value") * 100).cast("bigint")) / 10000).alias("price"))
    market = F.struct(F.when(c("event_id") % 10 == 0, "spreads").otherwise("h2h").alias("key"), F.array(outcome).alias("outcomes"))
    payload = F.struct(c("event_id").cast("string").alias("id"), F.concat(F.lit("H"), "user_id").alias("home_team"), F.concat(F.lit("A"), "user_id").alias("away_team"), F.lit("2024-01-01T00:00:00Z").alias("commence_time"), F.array(F.struct(c("event_type").alias("key"), F.array(market).alias("markets"))).alias("bookmakers"))
    rows, skipped = feeds.odds(_json(e, payload))
    kept = rows.select("id", "book", "side", rounded(F.col("price_decimal")).alias("price_decimal"))
    return kept.unionByName(skipped.select("id", F.split("reason", ":")[0].alias("book"), F.lit("skipped").alias("side"), F.lit(None).cast("double").alias("price_decimal")))


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    o = c("o_orderkey")
    side = lambda k, score: F.struct(F.struct(k.cast("int").alias("id"), F.concat(F.lit("T"), k.cast("string")).alias("name")).alias("team"), score.cast("int").alias("score"))
    innings = F.transform(F.sequence(F.lit(1), (o % 9 + 1).cast("int")), lambda i: F.struct(F.struct(((o + i) % 3).cast("int").alias("runs")).alias("home"), F.struct(F.when((o + i) % 13 != 0, ((o * 2 + i) % 4).cast("int")).alias("runs")).alias("away")))
    state = F.when(c("o_orderstatus") == "F", "Final").when(c("o_orderstatus") == "O", "Live").otherwise("Other")
    detail = F.when(o % 17 == 0, "Postponed").when(o % 19 == 0, "Cancelled").otherwise("As planned")
    game = F.struct(o.alias("gamePk"), F.lit("R").alias("gameType"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"), F.struct(state.alias("abstractGameState"), detail.alias("detailedState")).alias("status"),
                    F.struct(side(c("o_custkey") % 30, F.when(o % 23 != 0, o % 11)).alias("home"), side((c("o_custkey") + 1) % 30, o * 7 % 10).alias("away")).alias("teams"), F.struct(innings.alias("innings")).alias("linescore"))
    return _json(table(spark, sf_dir, "orders"), F.struct(F.array(F.struct(F.array(game).alias("games"))).alias("dates")))


@query("SELECT o_orderkey AS game_pk, CASE WHEN o_orderkey % 17 = 0 THEN 'postponed' WHEN o_orderkey % 19 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'live' ELSE 'scheduled' END AS status, 'T' || (o_custkey % 30) AS home_name, CAST((o_custkey + 1) % 30 AS INTEGER) AS away_id, epoch_us(o_orderdate) AS start_us FROM orders")
def r2_schedule_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule with its states."""
    return feeds.schedule(_schedule(spark, sf_dir)).select("game_pk", "status", "home_name", "away_id", F.unix_micros("start").alias("start_us"))


@query(
    """WITH g AS (SELECT o_orderkey AS o, range(1, o_orderkey % 9 + 2)[1:5] AS five FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0),
    u AS (SELECT o, unnest(five) AS i FROM g), s AS (SELECT o, count(*) AS n, count_if((o + i) % 13 = 0) AS gone, sum((o + i) % 3) AS h, sum((o * 2 + i) % 4) AS a FROM u GROUP BY o)
    SELECT o AS game_pk, CAST(o % 11 AS INTEGER) AS home_score, CAST(o * 7 % 10 AS INTEGER) AS away_score, CAST(CASE WHEN n = 5 AND gone = 0 THEN h END AS INTEGER) AS f5_home_score, CAST(CASE WHEN n = 5 AND gone = 0 THEN a END AS INTEGER) AS f5_away_score FROM s"""
)
def r3_results_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scores; five-inning sums only from ten known halves."""
    return feeds.results(_schedule(spark, sf_dir)).drop("place")


def _boxscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload a contest with its lines as players; some lines lack a count or contradict themselves."""
    c = F.col
    lines = B.logs(spark, sf_dir)
    i = lambda x: x.cast("int")
    bat = F.struct(i(c("outs")).alias("atBats"), F.when(c("player_id") % 9 != 0, i(c("k"))).alias("hits"), i(c("bb") % 4).alias("doubles"), i(c("hr") % 2).alias("homeRuns"), i(c("bb")).alias("baseOnBalls"), i(c("k") % 5).alias("strikeOuts"))
    pit = F.struct(F.when(c("player_id") % 4 == 0, 1).otherwise(0).alias("gamesStarted"), F.concat((c("outs") / 3).cast("int").cast("string"), F.lit("."), (c("outs") % 3).cast("string")).alias("inningsPitched"), F.when(c("player_id") % 8 != 0, i(c("bf"))).alias("battersFaced"), i(c("k")).alias("strikeOuts"), i(c("bb")).alias("baseOnBalls"), i(c("hr")).alias("homeRuns"))
    player = F.struct(F.struct(i(c("player_id")).alias("id"), F.concat(F.lit("P"), c("player_id").cast("string")).alias("fullName"), F.struct(c("hand").alias("code")).alias("pitchHand")).alias("person"), (c("player_id") % 12 * 100).cast("string").alias("battingOrder"), F.struct(bat.alias("batting"), pit.alias("pitching")).alias("stats"))
    side = lines.groupBy("event_id", "is_home").agg(F.array_sort(F.collect_list(i(c("player_id")))).alias("pitchers"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("ID"), F.lpad(c("player_id").cast("string"), 9, "0")).alias("key"), player.alias("value"))))).alias("players"))
    box = F.struct("pitchers", "players")
    games = side.groupBy("event_id").agg(F.max(F.when(c("is_home"), F.to_json(box))).alias("h"), F.max(F.when(~c("is_home"), F.to_json(box))).alias("a"))
    part = lambda k, s: F.concat(F.lit(f'"{k}":'), F.coalesce(s, F.lit("{}")))
    return games.select(c("event_id").alias("game"), F.concat(F.lit('{"teams":{'), part("home", c("h")), F.lit(","), part("away", c("a")), F.lit("}}")).alias("json"))


_BOX = B.cte("logs") + ", box AS (SELECT *, row_number() OVER (PARTITION BY event_id, is_home ORDER BY player_id) AS place FROM logs)"


@query(
    _BOX
    + """, s AS (SELECT *, CASE WHEN player_id % 9 = 0 THEN 'batting_missing:hits' WHEN k > outs OR bb % 4 + hr % 2 > k THEN 'batting_inconsistent' WHEN outs + bb = 0 THEN 'zero_pa' END AS reason FROM box),
    n AS (SELECT event_id, is_home FROM s GROUP BY ALL HAVING count_if(reason IS NULL) = 0)
    SELECT event_id AS game, CAST(player_id AS INTEGER) AS person, CASE WHEN reason IS NULL THEN 'kept' ELSE reason END AS disposition FROM s UNION ALL SELECT event_id, NULL, 'no_batting_lines_kept' FROM n"""
)
def r5_boxscore_batting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batting lines by what became of them."""
    return feeds.batting_told(_boxscores(spark, sf_dir))


def _pitching(boxscores: DataFrame) -> DataFrame:
    rows, _ = feeds.pitching(boxscores)
    return rows.select("game", "person", "is_home", "is_starter", "outs_recorded", "hand")


@query(
    _BOX
    + """, f AS (SELECT *, count_if(player_id % 4 = 0) OVER s AS flagged FROM box WINDOW s AS (PARTITION BY event_id, is_home)), c AS (SELECT *, CASE WHEN flagged > 0 THEN player_id % 4 = 0 ELSE place = 1 END AS cand FROM f),
    r AS (SELECT *, cand AND row_number() OVER (PARTITION BY event_id, is_home ORDER BY cand DESC, place) = 1 AS starter FROM c)
    SELECT event_id AS game, CAST(player_id AS INTEGER) AS person, is_home, starter AS is_starter, CAST(outs AS INTEGER) AS outs_recorded, hand FROM r WHERE player_id % 8 <> 0"""
)
def r4_boxscore_pitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitching lines with one starter a side; innings become outs."""
    return _pitching(_boxscores(spark, sf_dir))


@query(
    _BOX
    + """, s AS (SELECT *, player_id % 12 * 100 AS ord, row_number() OVER (PARTITION BY event_id, is_home, player_id % 12 ORDER BY player_id) AS n FROM box WHERE player_id % 12 > 0)
    SELECT event_id AS game, CAST(player_id AS INTEGER) AS person, CAST(ord AS INTEGER) AS batting_order, CASE WHEN n > 1 THEN 'duplicate' ELSE 'kept' END AS state FROM s WHERE n = 1
    UNION ALL SELECT event_id, NULL, NULL, CASE WHEN is_home THEN 'home' ELSE 'away' END || ':partial_lineup:' || count(*) FROM s WHERE n = 1 GROUP BY event_id, is_home HAVING count(*) < 9"""
)
def r6_boxscore_lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted starters; incomplete sides told."""
    return feeds.lineups_told(_boxscores(spark, sf_dir))


@query(
    """SELECT CASE WHEN event_id % 11 <> 0 THEN event_id END AS id, CASE WHEN event_id % 11 = 0 THEN 'without_id' WHEN event_id % 13 = 0 THEN 'without_person:' || event_id WHEN event_id % 17 = 0 THEN 'without_date:' || event_id ELSE 'kept' END AS state,
      CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 THEN ts::DATE::VARCHAR END AS day FROM events"""
)
def r7_transactions_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves; without an id, a person or a date they are reported."""
    e = F.col("event_id")
    t = F.struct(F.when(e % 11 != 0, e).alias("id"), F.struct(F.when(e % 13 != 0, F.col("user_id").cast("int")).alias("id")).alias("person"), F.lit("SC").alias("typeCode"), F.when(e % 17 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise("soon").alias("date"))
    rows, left = feeds.transactions(_json(table(spark, sf_dir, "events"), F.struct(F.array(t).alias("transactions"))))
    return rows.select(F.col("transaction_id").alias("id"), F.lit("kept").alias("state"), F.col("transaction_date").cast("string").alias("day")).unionByName(left.select("id", F.col("reason").alias("state"), F.lit(None).cast("string").alias("day")))


def _cycle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored events, and a cycle of feed rows: some known by id, some with an id re-issued, some new."""
    o, c = F.col("o_orderkey"), F.col
    base = table(spark, sf_dir, "orders").select(o, (c("o_custkey") % 40).alias("home"), (c("o_custkey") % 7).alias("away"), F.unix_micros("o_orderdate").alias("start_us"))
    events = base.select(o.alias("event_id"), "home", "away", "start_us", F.when(o % 3 == 1, F.concat(F.lit("id"), o.cast("string"))).when(o % 3 == 2, F.concat(F.lit("old"), o.cast("string"))).alias("odds_id"))
    feed = base.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("id"), o.cast("string")).alias("feed_id"), "home", "away", (c("start_us") + (o % 4) * 60_000_000).alias("start_us"))
    return events, feed


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, feed = _cycle(spark, sf_dir)
    return identity.resolve(feed, events)


#: The cascade in SQL: rows of a pair of teams go in turn through a recursion that carries the events that are taken.
_TURNS = """WITH RECURSIVE e AS (SELECT o_orderkey AS event_id, o_custkey % 40 AS home, o_custkey % 7 AS away, epoch_us(o_orderdate) AS s, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'id' || o_orderkey ELSE 'old' || o_orderkey END AS odds_id FROM orders),
    f AS (SELECT 'id' || o_orderkey AS feed_id, o_custkey % 40 AS home, o_custkey % 7 AS away, epoch_us(o_orderdate) + (o_orderkey % 4) * 60000000 AS t FROM orders WHERE o_orderkey % 5 <> 0),
    m AS (SELECT feed_id, event_id FROM f JOIN e ON odds_id = feed_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY t, feed_id) AS k FROM f WHERE feed_id NOT IN (SELECT feed_id FROM m)),
    c AS (SELECT *, odds_id IS NOT NULL AS stale FROM e WHERE odds_id IS NULL OR odds_id NOT IN (SELECT feed_id FROM f)),
    g AS (SELECT r.home, r.away, r.k, r.feed_id, coalesce(list(c.event_id) FILTER (WHERE stale AND abs(c.s - r.t) <= 300000000), []) AS old,
      coalesce(list(c.event_id ORDER BY abs(c.s - r.t), c.event_id) FILTER (WHERE NOT stale AND abs(c.s - r.t) <= 10800000000), []) AS free FROM r LEFT JOIN c USING (home, away) GROUP BY ALL),
    w AS (SELECT DISTINCT home, away, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS VARCHAR) AS feed_id, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS action FROM r
      UNION ALL SELECT home, away, k, CASE WHEN event_id IS NULL THEN taken ELSE list_append(taken, event_id) END, feed_id, event_id, action FROM (
        SELECT home, away, k, taken, feed_id, CASE WHEN len(o) = 1 THEN o[1] ELSE n[1] END AS event_id, CASE WHEN len(o) = 1 THEN 'restamped' WHEN len(n) > 0 THEN 'merged' WHEN len(o) > 1 THEN 'created_ambiguous' ELSE 'created' END AS action FROM (
          SELECT g.home, g.away, g.k, w.taken, g.feed_id, list_filter(g.old, lambda x: NOT list_contains(w.taken, x)) AS o, list_filter(g.free, lambda x: NOT list_contains(w.taken, x)) AS n FROM w JOIN g ON g.home = w.home AND g.away = w.away AND g.k = w.k + 1))),
    x AS (SELECT feed_id, event_id, action FROM w WHERE k > 0 UNION ALL SELECT feed_id, event_id, 'matched' FROM m)"""
ACTIONS = ("matched", "restamped", "merged", "created", "created_ambiguous")


@query(_TURNS + " SELECT " + ", ".join(f"count_if(action = '{a}') AS {a}" for a in ACTIONS) + ", count(*) AS rows FROM x")
def u9_u10_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows resolved tier by tier; counts of what became of them."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return _resolved(spark, sf_dir).agg(*map(n, ACTIONS), F.count(F.lit(1)).alias("rows"))


@query(_TURNS + " SELECT feed_id, event_id, action FROM x")
def u9_u10_identity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each feed row: its event and the tier that settled it."""
    return _resolved(spark, sf_dir)


@query(
    _TURNS.replace(
        "x AS (",
        """pairs AS (SELECT f.feed_id, e.event_id, f.home, f.away, abs(e.s - f.t) AS gap FROM f JOIN e USING (home, away) WHERE e.odds_id IS NULL AND abs(e.s - f.t) <= 10800000000),
    q AS (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY gap, feed_id, event_id) AS k FROM pairs),
    v AS (SELECT DISTINCT home, away, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS rows, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS VARCHAR) AS feed_id, CAST(NULL AS BIGINT) AS event_id FROM q
      UNION ALL SELECT home, away, k, CASE WHEN ok THEN list_append(rows, feed_id) ELSE rows END, CASE WHEN ok THEN list_append(taken, event_id) ELSE taken END, CASE WHEN ok THEN feed_id END, CASE WHEN ok THEN event_id END FROM (
        SELECT q.home, q.away, q.k, v.rows, v.taken, q.feed_id, q.event_id, NOT list_contains(v.rows, q.feed_id) AND NOT list_contains(v.taken, q.event_id) AS ok FROM v JOIN q ON q.home = v.home AND q.away = v.away AND q.k = v.k + 1)),
    x AS (""")
    + " SELECT feed_id, event_id FROM v WHERE feed_id IS NOT NULL"
)
def j15_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feed rows matched one to one with the events that have no id, nearest starts first."""
    events, feed = _cycle(spark, sf_dir)
    return identity.assign(feed, events.where("odds_id is null").withColumnRenamed("start_us", "s"), identity.MERGE_US)


@query(
    B.cte("odds")
    + """, p AS (SELECT DISTINCT event_id AS orphan_id, event_id - 1 AS to_id FROM odds WHERE event_id % 10 = 1), m AS (SELECT coalesce(p.to_id, o.event_id) AS event_id, book, side, captured_at_us // 86400000000 AS d, p.to_id IS NOT NULL AS orphan FROM (SELECT DISTINCT event_id, book, side, captured_at_us // 86400000000 * 86400000000 AS captured_at_us FROM odds) o LEFT JOIN p ON p.orphan_id = o.event_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_id, book, side, d ORDER BY orphan) AS rn FROM m) SELECT count_if(orphan AND rn = 1) AS repointed, count_if(orphan AND rn > 1) AS duplicates FROM n"""
)
def u12_orphan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orphan's rows repointed, those that its event has already dropped."""
    odds = B.entity(spark, sf_dir, "odds")
    snaps = odds.select("event_id", "book", F.lit("moneyline").alias("market"), "side", F.expr("captured_at_us div 86400000000").alias("captured_at")).distinct().withColumn("price", F.lit(1.9)).withColumn("is_closing", F.lit(False))
    pairs = odds.where("event_id % 10 = 1").select(F.col("event_id").alias("orphan_id"), (F.col("event_id") - 1).alias("event_id")).distinct()
    return identity.repaired(snaps, pairs)[1]


#: Events and prices with orphans: one with a sibling, some with none in reach or with two; a few outcomes have closings on either side.
_ORPHANS = B.cte("odds") + """, e AS (SELECT DISTINCT event_id, event_id // 10 AS home, CASE WHEN event_id % 10 IN (0, 1) OR event_id % 10 = 2 AND event_id // 10 % 5 = 0 THEN 0 ELSE event_id % 10 END AS away,
      event_id // 10 * 86400000000 + CASE WHEN event_id % 10 <> 1 THEN 0 WHEN event_id // 10 % 7 = 0 THEN 3600000000 ELSE 60000000 END AS start_us,
      CASE WHEN event_id % 10 = 1 OR event_id % 3 = 0 THEN 'o' || event_id END AS odds_id, CASE WHEN event_id % 10 <> 1 THEN 's' || event_id END AS schedule_id FROM odds),
    d AS (SELECT DISTINCT event_id, book, side, captured_at_us // 259200000000 AS captured_at FROM odds),
    n AS (SELECT *, captured_at = max(captured_at) OVER (PARTITION BY event_id, book, side) AND (event_id % 2 = 1 OR event_id // 10 % 3 = 0) AS is_closing FROM d),
    sib AS (SELECT o.event_id AS orphan_id, o.odds_id, list(s.event_id) FILTER (WHERE s.event_id IS NOT NULL) AS siblings FROM e o LEFT JOIN e s ON s.schedule_id IS NOT NULL AND s.home = o.home AND s.away = o.away AND abs(s.start_us - o.start_us) <= 300000000
      WHERE o.odds_id IS NOT NULL AND o.schedule_id IS NULL GROUP BY ALL),
    p AS (SELECT orphan_id, odds_id, siblings[1] AS to_id FROM sib WHERE len(siblings) = 1),
    o AS (SELECT n.*, to_id FROM n JOIN p ON orphan_id = event_id), s AS (SELECT * FROM n WHERE event_id NOT IN (SELECT orphan_id FROM p)),
    oc AS (SELECT to_id, book, side FROM s JOIN p ON to_id = event_id WHERE is_closing),
    dem AS (SELECT o.*, is_closing AND EXISTS (SELECT 1 FROM oc WHERE oc.to_id = o.to_id AND oc.book = o.book AND oc.side = o.side) AS demoted, EXISTS (SELECT 1 FROM s WHERE s.event_id = o.to_id AND s.book = o.book AND s.side = o.side AND s.captured_at = o.captured_at) AS dupe FROM o),
    pro AS (SELECT s.event_id, s.book, s.side, s.captured_at, s.is_closing OR EXISTS (SELECT 1 FROM dem WHERE to_id = s.event_id AND dem.book = s.book AND dem.side = s.side AND dem.captured_at = s.captured_at AND dem.is_closing AND NOT demoted) AS is_closing FROM s)"""


def _orphaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, tens = F.col, F.expr("event_id div 10")
    odds = B.entity(spark, sf_dir, "odds")
    last = c("event_id") % 10
    start = tens * 86_400_000_000 + F.when(last != 1, 0).when(tens % 7 == 0, 3_600_000_000).otherwise(60_000_000)
    named = lambda mark: F.concat(F.lit(mark), c("event_id").cast("string"))
    events = odds.select("event_id").distinct().select(
        "event_id", tens.alias("home"), F.when(last.isin(0, 1) | ((last == 2) & (tens % 5 == 0)), 0).otherwise(last).alias("away"), start.alias("start_us"),
        F.when((last == 1) | (c("event_id") % 3 == 0), named("o")).alias("odds_id"), F.when(last != 1, named("s")).alias("schedule_id"))
    snaps = odds.select("event_id", "book", F.lit("moneyline").alias("market"), "side", F.expr("captured_at_us div 259200000000").alias("captured_at")).distinct().withColumn("price", F.lit(1.9))
    w = Window.partitionBy("event_id", "book", "side")
    return events, snaps.withColumn("is_closing", (c("captured_at") == F.max("captured_at").over(w)) & ((c("event_id") % 2 == 1) | (tens % 3 == 0)))


@query(_ORPHANS + " SELECT event_id, book, side, captured_at, is_closing FROM pro UNION ALL SELECT to_id, book, side, captured_at, is_closing AND NOT demoted FROM dem WHERE NOT dupe")
def u12_repaired_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices after the repair, with the closing flags that stand."""
    events, snaps = _orphaned(spark, sf_dir)
    return repair.repair(events, snaps, repair.orphans(events))[1].select("event_id", "book", "side", "captured_at", "is_closing")


@query(_ORPHANS + " SELECT e.event_id, coalesce(p.odds_id, e.odds_id) AS odds_id, schedule_id FROM e LEFT JOIN p ON to_id = e.event_id WHERE e.event_id NOT IN (SELECT orphan_id FROM p)")
def u12_repaired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after the repair: drained orphans are gone, their ids handed over."""
    events, snaps = _orphaned(spark, sf_dir)
    return repair.repair(events, snaps, repair.orphans(events))[0].select("event_id", "odds_id", "schedule_id")


@query(
    _ORPHANS
    + """ SELECT s.orphan_id, CASE WHEN coalesce(len(siblings), 0) = 0 THEN 'no_sibling' WHEN len(siblings) > 1 THEN 'ambiguous' ELSE 'repairable' END AS state, CASE WHEN len(siblings) = 1 THEN siblings[1] END AS event_id,
    CASE WHEN len(siblings) = 1 THEN count_if(demoted) END AS demoted, CASE WHEN len(siblings) = 1 THEN count_if(dupe AND dem.is_closing AND NOT demoted) END AS promoted, CASE WHEN len(siblings) = 1 THEN count_if(dupe) END AS duplicates, CASE WHEN len(siblings) = 1 THEN count_if(NOT dupe) END AS repointed
    FROM sib s LEFT JOIN dem ON dem.event_id = s.orphan_id GROUP BY s.orphan_id, siblings"""
)
def u12_repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan with its state and what the repair does with its prices."""
    events, snaps = _orphaned(spark, sf_dir)
    found = repair.orphans(events)
    report = repair.repair(events, snaps, found)[2].drop("event_id")
    return found.select("orphan_id", "state", "event_id").join(report, "orphan_id", "left")


@query("WITH h AS (SELECT user_id, arg_max(props, ts) AS latest FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, arg_max(props, ts) AS props FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT b.user_id, b.props FROM b LEFT JOIN h USING (user_id) WHERE latest IS DISTINCT FROM props")
def u7_appended_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a batch only what differs from the latest known value is written."""
    e = table(spark, sf_dir, "events")
    batch = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.max_by("props", "ts").alias("props"))
    return histories.appended(e.where("event_id % 2 = 0").select("user_id", "props", "ts"), batch, ["user_id"], "props", "ts")


@query("SELECT event_id, user_id, event_type FROM events")
def s6_stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, U1, §2.16: prices land as files, are deduplicated within the watermark and appended; each row comes out once."""
    from tidemark.sources.tables import instants

    adopt(spark)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = instants(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "user_id", "event_type", "ts")
    rows.union(rows.where("event_id % 3 = 0")).write.parquet(f"{root}/landing")
    stream = spark.readStream.schema("event_id bigint, user_id bigint, event_type string, ts timestamp").parquet(f"{root}/landing")
    capture.append(capture.deduplicated(stream, "40 days", ["event_id"], "ts"), f"{root}/table", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/table").select("event_id", "user_id", "event_type")


@query(ORACLE["w7_v7_gaps"])
def v7_gap_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7, W7, §2.16: the holes of the archive as the alarm tells them while listings and captures stream by."""
    odds = B.entity(adopt(spark), sf_dir, "odds")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    hour = 3_600_000_000
    rows = alarms.listed(starts(odds), odds.select("event_id", F.col("captured_at_us").alias("at")), "start_us", "at", 10 * hour)
    rows.write.json(f"{root}/landing")
    alarms.tick(spark, odds.agg(F.max("captured_at_us")).first()[0] + 100 * 24 * hour if not rows.isEmpty() else 0).write.mode("append").json(f"{root}/landing")
    alarms.run(spark, f"{root}/landing", f"{root}/alarms", 10 * hour, 2 * hour, "40 days", files=1000).awaitTermination()
    told = spark.read.schema(alarms.ALARMS).parquet(f"{root}/alarms")
    return told.where("kind = 'hole'").select(F.col("event_id").cast("bigint").alias("event_id"), "from_us", "to_us")


#: Instant of the first capture; each of the others comes a day after the one before.
CAPTURED_US = 662_688_000_000_000


def captures_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """Scheduled events (event_id, home, away, start_us), and three captures of the feed (captured_at, place, json): in the second a sixth of the ids are
    issued anew and games that nobody scheduled appear, in the third a few are issued again."""
    o, c = F.col("o_orderkey"), F.col
    games = table(spark, sf_dir, "orders").select(o, F.concat(F.lit("H"), c("o_custkey") % 40).alias("home"), F.concat(F.lit("A"), c("o_custkey") % 7).alias("away"), F.unix_micros("o_orderdate").alias("start_us"))
    scheduled = games.where("o_orderkey % 5 <> 4").select(o.cast("string").alias("event_id"), "home", "away", "start_us")
    listed = [(o % 2 == 0, F.lit("a"), F.lit(0)), ((o % 2 == 0) | (o % 3 == 0), F.when(o % 6 == 0, "b").otherwise("a"), (o % 6 == 0).cast("int")), (o % 4 == 0, F.when(o % 12 == 0, "c").when(o % 6 == 0, "b").otherwise("a"), (o % 12 == 0).cast("int"))]
    out = []
    for k, (chosen, mark, drift) in enumerate(listed):
        start = F.timestamp_micros(c("start_us") + drift * 60_000_000)
        outcomes = F.array(*[F.struct(c(n).alias("name"), (F.lit(p) + (o + k) % 50 / 100).alias("price")) for n, p in (("home", 1.5), ("away", 1.7))])
        market = F.struct(F.lit("h2h").alias("key"), outcomes.alias("outcomes"))
        payload = F.struct(F.concat(mark, o.cast("string")).alias("id"), c("home").alias("home_team"), c("away").alias("away_team"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"), F.array(F.struct(F.lit("book").alias("key"), F.array(market).alias("markets"))).alias("bookmakers"))
        out.append(games.where(chosen).select(F.timestamp_micros(F.lit(CAPTURED_US + k * B.DAY_US)).alias("captured_at"), o.alias("place"), F.to_json(payload).alias("json")))
    return scheduled, out


@query()
def u10_stream_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U10, S6, §2.16: captures land as JSON, a stream resolves each against what those before it wrote; events with their ids and prices."""
    scheduled, captures = captures_of(adopt(spark), sf_dir)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    resolver.seed(scheduled, root, buckets=8)
    for k, c in enumerate(captures):
        landing.land_whole(c, f"{root}/landing", F.timestamp_micros(F.lit(CAPTURED_US + k * B.DAY_US)))
    resolver.run(spark, f"{root}/landing", root, buckets=8).awaitTermination()
    prices = resolver.table(spark, root, "prices").groupBy("event_id").agg(F.count(F.lit(1)).alias("prices"))
    events = resolver.table(spark, root, "events").join(prices, "event_id", "left")
    return events.select("event_id", "home", "away", "start_us", "odds_id", F.array_join(F.array_sort(F.coalesce("former_ids", F.array().cast("array<string>"))), ",").alias("former_ids"), F.coalesce("prices", F.lit(0)).alias("prices"))


@query()
def l1_l8_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form features, walk-forward by season, logistic with calibration, constant baseline; one row a season and model."""
    rows = asof.rolling(B.sides(spark, sf_dir), ["team"], "start_us", {"30d": (-30 * B.DAY_US, -1)}, {"n": F.lit(1), "w": (F.col("scored") > F.col("allowed")).cast("int"), "s": F.col("scored")})
    n = F.coalesce("n_30d", F.lit(0))
    own = rows.select("event_id", "is_home", n.cast("double").alias("games"), X.known_ratio(F.col("w_30d"), n).alias("win"), X.known_ratio(F.col("s_30d"), n).alias("runs"))
    wide = asof.per_side(own, ["event_id"], ["games", "win", "runs"])
    games = B.contests(spark, sf_dir).where("status = 'final' and home_score <> away_score").select("event_id", F.year("start").alias("season"), (F.col("home_score") > F.col("away_score")).cast("double").alias("target"))
    frame = games.join(wide, "event_id").persist()  # every season's fit reads it again
    columns = [f"{s}_{c}" for s in ("home", "away") for c in ("games", "win", "runs")]
    report = walkforward.walk_forward(frame, columns)
    frame.unpersist()
    out = [(int(s), m, r["n"], r["log_loss"], r["brier"], r["ece"]) for s, by in report["seasons"].items() for m, r in by.items()]
    return spark.createDataFrame(out, "season int, model string, n bigint, log_loss double, brier double, ece double")


@query()
def l1_l3_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training job, L1-L5, L7, L8: the full vectors of both markets, the logistic and the boosted model beside constant, home rate and market prior, with
    the gate; one row for each market, season and model. ``beats_prior`` is NULL while the gate isn't evaluated."""
    from tidemark.plans import feature_queries as Q

    games = B.contests(spark, sf_dir).where("status = 'final'")
    fair = games.select("event_id", (F.lit(0.45) + (F.col("event_id") % 11) / 100).alias("p_home")).where("event_id % 4 <> 0")
    said = jobs.train(games, Q.blocks(spark, sf_dir), {"moneyline": fair})
    out = []
    for market, m in said["markets"].items():
        for season, by in m["seasons"].items():
            beaten = by.get("market", {}).get("gate", {}).get("beaten_by", {})
            out += [(market, int(season), n, r["n"], r["log_loss"], r["brier"], r["ece"], beaten.get(n)) for n, r in by.items() if n != "market"]
            if "market" in by:
                r = by["market"]["market_prior"]
                out.append((market, int(season), "market_prior", r["n"], r["log_loss"], r["brier"], r["ece"], None))
    return spark.createDataFrame(out, "market string, season int, model string, n bigint, log_loss double, brier double, ece double, beats_prior boolean")


_COVERED = {n: c for n, c in jobs.COVERAGE.items() if n in ("sp", "offense", "lineup", "star_out")}


def _home_rates(market: str, h: str, a: str) -> str:
    """Each decided game with the share of home wins among those that start strictly before."""
    return f"""{market}_g AS (SELECT event_id, start, CAST({h} > {a} AS INTEGER) AS t FROM contests WHERE status = 'final' AND {h} <> {a}), {market}_d AS (SELECT start, sum(t) AS w, count(*) AS n FROM {market}_g GROUP BY start),
      {market}_r AS (SELECT start, coalesce(sum(w) OVER x / nullif(sum(n) OVER x, 0), 0.5) AS p FROM {market}_d WINDOW x AS (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _baseline_sql() -> str:
    share = ", ".join(f"round(avg(CASE WHEN home_{c} IS NOT NULL AND away_{c} IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS {n}_coverage" for n, c in _COVERED.items())
    p = "least(greatest(p, 0.000001), 0.999999)"
    one = lambda market, name: f"""SELECT '{market}' AS market, v.season, count(*) AS n, round(avg(v.target), 4) AS home_wins, round(avg(-(v.target * ln({p}) + (1 - v.target) * ln(1 - {p}))), 5) AS home_rate_log_loss,
      round(avg((p - v.target) * (p - v.target)), 5) AS home_rate_brier, round(avg(-ln(0.5)), 5) AS constant_log_loss, {share} FROM ({ORACLE[name]}) v JOIN {market}_g g USING (event_id) JOIN {market}_r r ON r.start = g.start GROUP BY v.season"""  # noqa: E731
    return f"{B.cte('contests')}, {_home_rates('moneyline', 'home_score', 'away_score')}, {_home_rates('f5_moneyline', 'f5_home', 'f5_away')} {one('moneyline', 'f28_full_vector')} UNION ALL {one('f5_moneyline', 'f28_f5_vector')}"


@query(_baseline_sql())
def l6_l8_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both markets' training vectors by season their number, home wins, coverage, and how a constant and the running home rate score."""
    from tidemark.plans import feature_queries as Q

    games, only = B.contests(spark, sf_dir).where("status = 'final'"), set(_COVERED.values())
    blocks = X.together(Q.blocks(spark, sf_dir, [b for b, columns in X.BLOCKS.items() if only & set(columns)]), only)
    frames = side_by_side([lambda m=m: cut(X.training_frame(games, blocks, m, only)) for m in X.MARKETS])
    out = None
    for market, frame in zip(X.MARKETS, map(walkforward.home_rate, frames)):
        both = lambda c: F.avg((F.col(f"home_{c}").isNotNull() & F.col(f"away_{c}").isNotNull()).cast("double"))
        counts = frame.groupBy("season").agg(rounded(F.avg("target")).alias("home_wins"), rounded(F.avg(-F.ln(F.lit(0.5))), 5).alias("constant_log_loss"), *[rounded(both(c)).alias(f"{n}_coverage") for n, c in _COVERED.items()])
        scored = metrics.report(frame, ["season"], y="target", p="__home_rate").select("season", "n", F.col("log_loss").alias("home_rate_log_loss"), F.col("brier").alias("home_rate_brier"))
        rows = scored.join(counts, "season").withColumn("market", F.lit(market))
        out = rows if out is None else out.unionByName(rows)
    return out
