"""The vector of one event at an instant: the bulk blocks over one target, with nothing that wasn't known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import features as X

#: Counts of a line that aren't known before its contest.
_OPEN = ("outs", "bf", "k", "bb", "hbp", "hr", "fly", "sac", "pitches")


def blocks(event_id, start_us: int, as_of_us: int, sides: DataFrame, starts: DataFrame, relief: DataFrame, batting: DataFrame, lineup: DataFrame, moves: DataFrame, confirmed: DataFrame | None = None) -> dict[str, DataFrame]:
    """All blocks of one event from histories with start_us. sides: home and away rows of contests; starts: starters' lines, the event's own telling who is
    announced; relief: other pitchers' lines; batting: lines with opp_hand; lineup: the event's batters (player_id, team, slot, opp_hand); moves: player_id,
    at_day, txn_id, effect. Rows from as_of on are left out, but for the event's own teams and announced players, without what they did."""
    past = lambda df: df.where(F.col("start_us") < as_of_us)
    own = lambda df: df.where(F.col("event_id") == event_id)
    unknown = lambda df, columns: df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
    here = own(sides)
    teams = here.select("event_id", "team", "is_home", "start_day")
    form = X.rolling_form(past(sides).unionByName(unknown(here, ("status", "scored", "allowed", "f5_scored", "f5_allowed"))))
    starter = X.starter_form(past(starts).unionByName(unknown(own(starts), _OPEN)))
    starter = own(starter).withColumnRenamed("ip_expected", "bullpen_ip_expected")
    hands = own(starts).groupBy((~F.col("is_home")).alias("is_home")).agg(F.max("hand").alias("opp_hand"))
    against = teams.join(hands, "is_home", "left")
    known, pen, told = past(batting), past(relief), moves.where(F.col("at_day") < F.date_diff(F.timestamp_micros(F.lit(start_us)), F.lit("1970-01-01").cast("date")))
    batters = X.batter_form(own(lineup), known)
    made = {
        "form": own(form), "offense": X.offense(teams, known), "split": X.split_offense(against, known), "lineup": X.lineup(batters), "stars": X.star_out(teams, known, told),
        "starter": starter, "expected": starter, "bullpen": X.bullpen_load(teams, pen), "arms": X.bullpen_out(teams, pen, told)}
    return made | ({"confirmed": confirmed} if confirmed is not None else {})


def vector(event_id, market: str, as_of_us: int, **tables: DataFrame) -> dict:
    """One event's vector as a dict, by name of column. LookupError if the event isn't known, ValueError if the instant is after its start: such a vector
    would hold what nobody could know when deciding."""
    row = tables["sides"].where(F.col("event_id") == event_id).agg(F.min("start_us").alias("start_us")).first()
    if row is None or row["start_us"] is None:
        raise LookupError(f"event {event_id} is not known")
    if as_of_us > row["start_us"]:
        raise ValueError(f"{as_of_us} is after the start of event {event_id} ({row['start_us']})")
    events = tables["sides"].where(F.col("event_id") == event_id).select("event_id").distinct()
    found = X.vectors(events, blocks(event_id, row["start_us"], as_of_us, **tables), market).drop("event_id").first()
    return found.asDict()
