"""Performance lines are dealt once by contest, frames of a vector once by event, and a line that is target and history travels once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans import bindings as B
from tidemark.plans import feature_queries as Q
from tidemark.plans import features as X

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_lines_are_read_and_dealt_once(spark):
    """Sums, ranks, hands and contests of the line-up projection share a shuffle; before, each had the lines read and dealt anew."""
    text = plan(Q.f23_lineup_projection(spark, SF))
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange hashpartitioning(event_id") <= 3  # lines, contests and the sides' sums


@needs_tables
def test_opposing_hand_of_ranked_lines(spark):
    starts = {(r.event_id, r.is_home): r.hand for r in Q.starters(spark, SF).collect()}
    rows = B.ranked(spark, SF).collect()
    assert len(rows) > 1000 and all(r.opp_hand == starts.get((r.event_id, not r.is_home)) for r in rows)
    sides = {}
    for r in rows:
        sides.setdefault((r.event_id, r.is_home), []).append((r.rn, r.player_id))
    assert all([n for n, _ in sorted(x)] == list(range(1, len(x) + 1)) and sorted(x, key=lambda y: y[1]) == sorted(x) for x in sides.values())


def test_own_sums(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), rng.randint(-50, 400), rng.choice([None, 1, 4])) for k in range(500)]
    df = spark.createDataFrame(rows, "n long, key string, day long, x long")
    got = asof.own_sums(df, ["key"], "day", {"w": (-30, -1), "near": (-3, 2)}, {"x": F.col("x"), "c": F.lit(1)}).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for _, k, d, x in rows if k == r.key and r.day - 30 <= d <= r.day - 1]
        assert r.c_w == (len(own) or None) and r.x_w == (sum(x for x in own if x) or None)
        assert r.x_near == (sum(x or 0 for _, k, d, x in rows if k == r.key and r.day - 3 <= d <= r.day + 2) or None)


def test_frames_of_a_vector_are_dealt_once(spark):
    events = spark.range(50).select(F.col("id").alias("event_id"))
    sides = spark.range(100).select((F.col("id") % 50).alias("event_id"), (F.col("id") < 50).alias("is_home"))
    blocks = {b: sides.select("event_id", "is_home", *[F.col("event_id").cast("double").alias(c) for c in X.BLOCKS[b]]) for b in ("form", "offense", "bullpen")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = X.vectors(events, blocks, "moneyline")
        assert plan(found).count("Exchange hashpartitioning") == 4  # the events and three frames
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = found.collect()
    assert len(rows) == 50 and all(r.home_woba_30d == r.event_id and r.away_bullpen_b2b == r.event_id and r.home_star_out_flag is None and r.home_lineup_is_confirmed == 0 for r in rows)


@needs_tables
@pytest.mark.parametrize("name", ["r4_boxscore_pitching", "r5_boxscore_batting", "r6_boxscore_lineup"])
def test_box_scores_are_made_and_parsed_once(spark, name):
    """Before, each disposition had the box scores made and parsed anew; no shuffle but that of lines and contests is left."""
    from tidemark import plans

    text = plan(plans.QUERIES[name](spark, SF))
    assert text.count("lineitem.parquet") == 1 and text.count("Exchange hashpartitioning") <= 2


def test_copies_of_a_snapshot_meet_before_the_shuffle(spark):
    rows = [(1, "m", "x", 5), (1, "m", "x", 3), (1, "f", "x", 9), (2, "m", "y", None), (2, "m", "y", 1), (3, "m", "z", 2)]
    df = spark.createDataFrame(rows, "event_id long, market string, features_hash string, as_of long")
    found = X.new_snapshots(df, df.where("event_id = 3"))
    assert "Window" not in plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "f", "x", 9), (1, "m", "x", 3), (2, "m", "y", None)]


def test_columns_that_are_read_travel_together(spark, monkeypatch):
    """Before, all blocks were made, written one by one and joined to each market's games to count four columns."""
    games = spark.range(60).selectExpr("id AS event_id", "timestamp_micros(id * 86400000000) AS start", "id % 3 AS home_score", "1 AS away_score", "id % 5 AS f5_home", "2 AS f5_away")
    sides = spark.range(120).selectExpr("id % 60 AS event_id", "id < 60 AS is_home")
    value = lambda k: F.when((F.col("event_id") + F.col("is_home").cast("int")) % k > 0, F.col("event_id") % k)
    blocks = {b: sides.where(F.col("event_id") % (k + 5) > 0).select("*", *[value(k + i + 2).cast("double").alias(c) for i, c in enumerate(X.BLOCKS[b])]) for k, b in enumerate(("form", "offense", "stars", "starter"))}
    only, written = {"woba_30d", "star_out_flag", "sp_kbb_l5"}, []
    monkeypatch.setattr(X, "cut", lambda df: written.append(df.columns) or df)
    few = X.together(blocks, only)
    assert set(few) == {"offense", "starter", "stars"} and len({id(df) for df in few.values()}) == 1
    assert written == [["event_id", "is_home", "woba_30d", "star_out_flag", "sp_kbb_l5"]] and X.together(blocks, {"bullpen_b2b"}) == {}
    for market in X.MARKETS:
        got = X.training_frame(games, few, market, only)
        assert plan(got).count("Join") == 1 and len(got.columns) == 10
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, X.training_frame(games, blocks, market).select(got.columns).collect()), key=str)


def test_tables_of_the_shared_folder_leave_no_shuffle_files(spark):
    """Before, the shuffles of all blocks of a vector stayed on disk until its last join was done."""
    import time

    from tidemark import session

    key = session._FREE
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllFiles()
        return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.startswith("shuffle_") and name.endswith(".data")}

    before, was = shuffled(), spark.conf.get(key)
    rows = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    made = session.side_by_side([lambda: session.cut(rows) for _ in range(3)])
    for _ in range(100):  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(key) == was
    assert all(x.count() == 7 for x in made)


@needs_tables
def test_full_vectors_are_joined_from_kept_blocks(spark, monkeypatch):
    """Each block is a table before the vector is joined, so that its shuffles are gone by then."""
    from tidemark import plans

    asked, kept = [], X.kept
    monkeypatch.setattr(X, "kept", lambda blocks: asked.append(sorted(blocks)) or kept(blocks))
    for name in ("f28_full_vector", "f28_f5_vector"):
        assert plans.QUERIES[name](spark, SF).count() > 0
    assert asked == [sorted(b for b in X.BLOCKS if b != "confirmed")] * 2
