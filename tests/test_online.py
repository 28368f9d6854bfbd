"""The online vector equals the bulk one at the start, holds nothing that came later, and is refused after the start."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import bindings as B
from tidemark.plans import feature_queries as Q
from tidemark.plans import features as X
from tidemark.plans import online

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_online_equals_bulk(spark):
    slot = F.least(F.lit(9), F.row_number().over(Q.Window.partitionBy("event_id", "is_home").orderBy("player_id")))
    starts = Q.starters(spark, SF).cache()
    lines = Q._with_opposing_hand(B.batting(spark, SF), starts).cache()
    lineup = lines.select("event_id", "player_id", "team", "is_home", "start_day", "opp_hand", slot.alias("slot"))
    tables = {"sides": B.sides(spark, SF).cache(), "starts": starts, "relief": Q.starters(spark, SF, first=False).cache(), "batting": lines, "lineup": lineup, "moves": Q._moves(spark, SF).cache()}
    games = B.contests(spark, SF).where("status = 'final'")
    for market in X.MARKETS:
        bulk = X.training_frame(games, Q.blocks(spark, SF), market)
        row = bulk.where("home_sp_kbb_l5 is not null and away_star_out_flag is not null").orderBy(F.desc("event_id")).first() or bulk.where("home_woba_30d is not null").orderBy(F.desc("event_id")).first()
        start = int(B.contests(spark, SF).where(F.col("event_id") == row.event_id).first().start_us)
        got = online.vector(row.event_id, market, start, **tables)
        assert got == {c: row[c] for c in X.vector_columns(market)}
    # ten days before, later contests don't exist: what they did may be anything
    as_of = start - 10 * 86_400_000_000
    late = F.col("start_us") >= as_of
    other = tables | {"sides": tables["sides"].withColumn("scored", F.when(late, F.lit(99)).otherwise(F.col("scored"))), "batting": lines.withColumn("h", F.when(late, F.col("h") + 50).otherwise(F.col("h")))}
    assert online.vector(row.event_id, market, as_of, **tables) == online.vector(row.event_id, market, as_of, **other)
    with pytest.raises(ValueError, match="after the start"):
        online.vector(row.event_id, market, start + 1, **tables)
    with pytest.raises(LookupError):
        online.vector(-1, market, start, **tables)
