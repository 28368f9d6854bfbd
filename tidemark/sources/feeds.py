"""JSON feeds to typed rows. Each parser classifies every entry once and gives two frames: rows, and what was left out.

Input frames have one column of JSON text for each payload; nested entries are exploded by the plan, not by loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.pricing import decimal_to_american
from tidemark.functions.scalars import innings_to_outs, instant, tolerant_date

#: Feed markets and states, and what they are called here.
MARKET_CODES = {"h2h": "moneyline", "h2h_1st_5_innings": "f5_moneyline"}
ABSTRACT_STATES = {"Preview": "scheduled", "Live": "live", "Final": "final"}
MIN_PRICE = 1.001

ODDS = "struct<id:string,home_team:string,away_team:string,commence_time:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:double>>>>>>>"
_SIDE = "struct<team:struct<id:int,name:string>,score:int,probablePitcher:struct<id:int,fullName:string>>"
SCHEDULE = f"struct<dates:array<struct<games:array<struct<gamePk:bigint,gameType:string,gameDate:string,status:struct<abstractGameState:string,detailedState:string>,teams:struct<home:{_SIDE},away:{_SIDE}>,linescore:struct<innings:array<struct<home:struct<runs:int>,away:struct<runs:int>>>>>>>>>"
_BAT = "struct<atBats:int,hits:int,doubles:int,triples:int,homeRuns:int,baseOnBalls:int,intentionalWalks:int,strikeOuts:int,hitByPitch:int,sacFlies:int,sacBunts:int,plateAppearances:string>"
_PIT = "struct<gamesStarted:int,outs:int,inningsPitched:string,battersFaced:int,strikeOuts:int,baseOnBalls:int,hitBatsmen:int,homeRuns:int,flyOuts:int,groundOuts:int,sacFlies:int,numberOfPitches:int>"
_BOX = f"struct<pitchers:array<int>,players:map<string,struct<person:struct<id:int,fullName:string,pitchHand:struct<code:string>>,battingOrder:string,stats:struct<batting:{_BAT},pitching:{_PIT}>>>>"
BOXSCORE = f"struct<teams:struct<home:{_BOX},away:{_BOX}>>"
PEOPLE = "struct<people:array<struct<id:int,fullName:string,pitchHand:struct<code:string>>>>"
TRANSACTIONS = "struct<transactions:array<struct<id:bigint,person:struct<id:int,fullName:string>,typeCode:string,typeDesc:string,description:string,date:string,effectiveDate:string,toTeam:struct<id:int,name:string>,fromTeam:struct<id:int,name:string>>>>"


def _mapped(col: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), col)


def _split(df: DataFrame, reason: str, rows: list, anomaly: list) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()).select(*rows), df.where(F.col(reason).isNotNull()).select(*anomaly, F.col(reason).alias("reason"))


def odds(payloads: DataFrame, text: str = "json", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Priced outcomes of known markets; other markets, other outcomes (a draw) and prices too low are reported. ``keep``: columns of the
    payloads that rows carry on."""
    e = payloads.select(*keep, F.from_json(text, ODDS).alias("e")).select(*keep, "e.*")
    e = e.select(*keep, "id", "home_team", "away_team", instant(F.col("commence_time")).alias("start"), F.explode("bookmakers").alias("b")).select("*", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).drop("b")
    e = e.withColumn("market", _mapped(F.col("m.key"), MARKET_CODES)).select("*", F.col("m.key").alias("feed_market"), instant(F.col("m.last_update")).alias("last_update"), F.explode_outer("m.outcomes").alias("o")).drop("m")
    side = F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away")
    e = e.withColumn("side", side).withColumn("price_decimal", F.col("o.price"))
    reason = F.when(F.col("market").isNull(), F.concat_ws(":", "book", F.lit("market"), "feed_market")).when(F.col("side").isNull(), F.concat_ws(":", "book", "market", F.lit("outcome"), "o.name"))
    reason = reason.when(~F.coalesce(F.col("price_decimal") > MIN_PRICE, F.lit(False)), F.concat_ws(":", "book", "market", "side", F.lit("price"), F.col("price_decimal").cast("string")))
    e = e.withColumn("reason", reason)
    rows, left = _split(e, "reason", [*keep, "id", "start", "home_team", "away_team", "book", "market", "side", "price_decimal", F.bround(decimal_to_american("price_decimal")).cast("int").alias("price_american"), "last_update"], ["id"])
    return rows, left.distinct()


def _games(payloads: DataFrame, text: str, seen: str | None) -> DataFrame:
    """Game entries with their place: a later payload (by the column ``seen``, where one is named) goes after an earlier one, then
    days and games in the order of the payload."""
    days = payloads.select((F.col(seen) if seen else F.lit(0)).alias("seen"), F.posexplode(F.from_json(text, SCHEDULE)["dates"]).alias("day_at", "d"))
    games = days.select("seen", "day_at", F.posexplode("d.games").alias("game_at", "g"))
    return games.select("g.*", F.struct("seen", "day_at", "game_at").alias("place"))


def schedule(payloads: DataFrame, text: str = "json", seen: str | None = None) -> DataFrame:
    """R2: games with their state; a postponed or cancelled detail goes before the abstract state, unknown states are scheduled.
    ``place`` orders listings."""
    g = _games(payloads, text, seen)
    status = F.coalesce(_mapped(F.col("status.detailedState"), {"Postponed": "postponed", "Cancelled": "cancelled"}), _mapped(F.col("status.abstractGameState"), ABSTRACT_STATES), F.lit("scheduled"))
    side = lambda s: [F.col(f"teams.{s}.team.name").alias(f"{s}_name"), F.col(f"teams.{s}.team.id").alias(f"{s}_id"), F.col(f"teams.{s}.probablePitcher.id").alias(f"{s}_probable_id"), F.col(f"teams.{s}.probablePitcher.fullName").alias(f"{s}_probable")]
    return g.select(F.col("gamePk").alias("game_pk"), instant(F.col("gameDate")).alias("start"), F.col("gameType").alias("game_type"), status.alias("status"), *side("home"), *side("away"), "place")


def results(payloads: DataFrame, text: str = "json", seen: str | None = None) -> DataFrame:
    """Scores of finished games; five-inning sums only where all ten halves are known. ``place`` orders listings."""
    g = _games(payloads, text, seen).where("status.abstractGameState = 'Final' and coalesce(status.detailedState, '') not in ('Postponed', 'Cancelled') and teams.home.score is not null and teams.away.score is not null")
    five = F.slice(F.coalesce("linescore.innings", F.array().cast("array<struct<home:struct<runs:int>,away:struct<runs:int>>>")), 1, 5)
    known = (F.size(five) == 5) & F.forall(five, lambda i: i["home"]["runs"].isNotNull() & i["away"]["runs"].isNotNull())
    total = lambda s: F.when(known, F.aggregate(five, F.lit(0), lambda a, i: a + i[s]["runs"]))
    return g.select(F.col("gamePk").alias("game_pk"), F.col("teams.home.score").alias("home_score"), F.col("teams.away.score").alias("away_score"), total("home").alias("f5_home_score"), total("away").alias("f5_away_score"), "place")


def _entries(payloads: DataFrame, game: str, text: str) -> DataFrame:
    """One row for each player entry of both sides, in the order of the payload."""
    t = payloads.select(F.col(game).alias("game"), F.from_json(text, BOXSCORE)["teams"].alias("t"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"t.{s}.pitchers").alias("pitchers"), F.map_values(F.col(f"t.{s}.players")).alias("players")) for s in ("home", "away")])
    e = t.select("game", F.inline(sides)).select("game", "side", "pitchers", F.posexplode("players").alias("pos", "p"))
    return e.select("game", "side", "pitchers", "pos", F.col("p.person.id").alias("person"), F.coalesce("p.person.fullName", F.concat(F.lit("person "), F.col("p.person.id").cast("string"))).alias("name"), F.col("p.person.pitchHand.code").alias("hand"), F.col("p.battingOrder").try_cast("int").alias("batting_order"), "p.stats.batting", "p.stats.pitching")


def _missing(block: str, names: dict[str, Column]) -> Column:
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in names.items()])))


def _batted(payloads: DataFrame, game: str, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """Batting entries with the reason for which a line is left out, and the counts of a line."""
    e = _entries(payloads, game, text).where("batting is not null")
    b = {n: F.col(f"batting.{f}") for n, f in (("at_bats", "atBats"), ("hits", "hits"), ("strikeouts", "strikeOuts"), ("walks", "baseOnBalls"))}
    z = {n: F.coalesce(f"batting.{f}", F.lit(0)) for n, f in (("doubles", "doubles"), ("triples", "triples"), ("home_runs", "homeRuns"), ("intentional_walks", "intentionalWalks"), ("hit_by_pitch", "hitByPitch"), ("sac_flies", "sacFlies"), ("sac_bunts", "sacBunts"))}
    gone = _missing("batting", {"atBats": b["at_bats"], "hits": b["hits"], "strikeOuts": b["strikeouts"], "baseOnBalls": b["walks"]})
    bad = (F.least(*b.values(), *z.values()) < 0) | (b["hits"] > b["at_bats"]) | (z["doubles"] + z["triples"] + z["home_runs"] > b["hits"]) | (z["intentional_walks"] > b["walks"])
    empty = b["at_bats"] + b["walks"] + z["hit_by_pitch"] + z["sac_flies"] + z["sac_bunts"] == 0
    reason = F.when(F.col("person").isNull(), "batting_line_without_person_id").when(gone != "", F.concat(F.lit("batting_missing:"), gone)).when(bad, "batting_inconsistent").when(empty, "zero_pa")
    return e.withColumn("reason", reason), b | z


def batting(payloads: DataFrame, game: str = "game", text: str = "json") -> tuple[DataFrame, DataFrame]:
    """Batting lines. Lines without a person or a required count and inconsistent ones are reported, empty ones (reason
    ``zero_pa``) counted; a side of which no line is kept is reported as a whole."""
    e, counts = _batted(payloads, game, text)
    pa = F.col("batting.plateAppearances").try_cast("int")
    rows, left = _split(e, "reason", ["game", "person", "name", (F.col("side") == "home").alias("is_home"), *[c.alias(n) for n, c in counts.items()], F.when(F.col("batting_order") >= 100, F.col("batting_order")).alias("batting_order"), F.when(pa >= 0, pa).alias("plate_appearances")], ["game", "side", "person"])
    none = e.where("person is not null").groupBy("game", "side").agg(F.count_if(F.col("reason").isNull()).alias("kept")).where("kept = 0").select("game", "side", F.lit(None).cast("int").alias("person"), F.lit("no_batting_lines_kept").alias("reason"))
    return rows, left.unionByName(none)


def batting_told(payloads: DataFrame, game: str = "game", text: str = "json") -> DataFrame:
    """What became of each batting entry, and a row for each side of which no line is kept: game, person, disposition (``kept`` or the reason). The two
    frames of ``batting`` say the same, but this reads and parses the payloads once."""
    e = _batted(payloads, game, text)[0].select("game", "side", "pos", "person", "reason")
    side = Window.partitionBy("game", "side")
    empty = (F.count("person").over(side) > 0) & (F.count_if(F.col("reason").isNull()).over(side) == 0) & (F.row_number().over(side.orderBy("pos")) == 1)
    row = lambda person, said: F.struct(person.alias("person"), said.alias("disposition"))
    told = F.array(row(F.col("person"), F.coalesce("reason", F.lit("kept"))), F.when(F.col("__empty"), row(F.lit(None).cast("int"), F.lit("no_batting_lines_kept"))))
    return e.withColumn("__empty", empty).select("game", F.inline(F.array_compact(told)))


def pitching(payloads: DataFrame, game: str = "game", text: str = "json") -> tuple[DataFrame, DataFrame]:
    """Pitching lines with one starter a side: the flagged one, of several the first to appear, without a flag the first of
    the appearance order (reported, as is any count but one). Lines without a required count are reported."""
    e = _entries(payloads, game, text).where("pitching is not null")
    outs = innings_to_outs(F.col("pitching.outs"), F.col("pitching.inningsPitched"))
    e = e.withColumn("outs", outs).withColumn("place", F.nullif(F.array_position("pitchers", F.col("person")), F.lit(0)))
    side = Window.partitionBy("game", "side")
    flagged = F.coalesce(F.col("pitching.gamesStarted") >= 1, F.lit(False)) & F.col("person").isNotNull()
    e = e.withColumn("n_flagged", F.sum(flagged.cast("int")).over(side))
    first = F.col("person").isNotNull() & (F.col("person") == F.try_element_at("pitchers", F.lit(1)))
    e = e.withColumn("candidate", F.when(F.col("n_flagged") > 0, flagged).otherwise(F.coalesce(first, F.lit(False))))
    e = e.withColumn("n_starters", F.sum(F.col("candidate").cast("int")).over(side))
    e = e.withColumn("is_starter", F.col("candidate") & (F.row_number().over(side.orderBy(F.desc("candidate"), F.coalesce("place", F.lit(1 << 30)), "pos")) == 1))
    gone = _missing("pitching", {"outs": F.col("outs"), "battersFaced": F.col("pitching.battersFaced"), "strikeOuts": F.col("pitching.strikeOuts"), "baseOnBalls": F.col("pitching.baseOnBalls")})
    e = e.withColumn("reason", F.when(F.col("person").isNull(), "pitching_line_without_person_id").when(gone != "", F.concat(F.lit("missing:"), gone)))
    c = lambda f: F.col(f"pitching.{f}")
    rows, left = _split(
        e, "reason",
        ["game", "person", "name", F.when(F.col("hand").isin("L", "R", "S"), F.col("hand")).alias("hand"), (F.col("side") == "home").alias("is_home"), "is_starter", F.col("outs").alias("outs_recorded"), c("battersFaced").alias("batters_faced"), c("strikeOuts").alias("strikeouts"), c("baseOnBalls").alias("walks"),
         F.coalesce(c("hitBatsmen"), F.lit(0)).alias("hit_batsmen"), F.coalesce(c("homeRuns"), F.lit(0)).alias("home_runs"), c("flyOuts").alias("fly_outs"), c("groundOuts").alias("ground_outs"), c("sacFlies").alias("sac_flies"), c("numberOfPitches").alias("pitches_thrown")],
        ["game", "side", "person"])
    state = e.groupBy("game", "side").agg(F.max("n_flagged").alias("f"), F.max("n_starters").alias("n"), F.max(F.when(F.col("is_starter"), F.col("person"))).alias("s"))
    notes = F.array_compact(F.array(F.when((F.col("f") == 0) & (F.col("n") > 0), F.concat(F.lit("starter_from_appearance_order:"), F.col("s").cast("string"))), F.when(F.col("n") != 1, F.concat(F.lit("starter_count:"), F.col("n").cast("string")))))
    told = state.select("game", "side", F.lit(None).cast("int").alias("person"), F.explode(notes).alias("reason"))
    return rows, left.unionByName(told)


def _posted(payloads: DataFrame, game: str, text: str) -> DataFrame:
    e = _entries(payloads, game, text).where("batting_order >= 100 and batting_order % 100 = 0").drop("pitchers", "batting", "pitching")
    w = Window.partitionBy("game", "side", "batting_order", F.col("person").isNull()).orderBy("pos")
    return e.withColumn("reason", F.when(F.col("person").isNull(), F.concat(F.lit("lineup_slot_without_person_id:"), F.col("batting_order").cast("string"))).when(F.row_number().over(w) > 1, F.concat(F.lit("duplicate_slot:"), F.col("batting_order").cast("string"))))


def lineups(payloads: DataFrame, game: str = "game", text: str = "json") -> tuple[DataFrame, DataFrame]:
    """Posted starters (orders 100, 200, ...); of a slot that comes twice the first entry stands; sides with one to eight are reported."""
    e = _posted(payloads, game, text)
    rows, left = _split(e, "reason", ["game", "person", "name", (F.col("side") == "home").alias("is_home"), "batting_order"], ["game", "side"])
    partial = e.where("reason is null").groupBy("game", "side").count().where("count < 9").select("game", "side", F.concat(F.lit("partial_lineup:"), F.col("count").cast("string")).alias("reason"))
    return rows, left.unionByName(partial)


def lineups_told(payloads: DataFrame, game: str = "game", text: str = "json") -> DataFrame:
    """Posted starters and a row for each incomplete side: game, person, batting_order, state (``kept`` or ``<side>:partial_lineup:<n>``); the payloads are
    read and parsed once."""
    e = _posted(payloads, game, text).where("reason is null").select("game", "side", "person", "batting_order")
    side = Window.partitionBy("game", "side")
    e = e.withColumn("__n", F.count(F.lit(1)).over(side)).withColumn("__at", F.row_number().over(side.orderBy("batting_order")))
    row = lambda person, order, state: F.struct(person.alias("person"), order.alias("batting_order"), state.alias("state"))
    none = F.lit(None).cast("int")
    told = F.when((F.col("__n") < 9) & (F.col("__at") == 1), row(none, none, F.concat("side", F.lit(":partial_lineup:"), F.col("__n").cast("string"))))
    return e.select("game", F.inline(F.array_compact(F.array(row(F.col("person"), F.col("batting_order"), F.lit("kept")), told))))


def people(payloads: DataFrame, text: str = "json") -> DataFrame:
    """Persons of the people feed with their throwing hand; entries without an id are left out, unknown hands NULL."""
    p = payloads.select(F.explode(F.from_json(text, PEOPLE)["people"]).alias("p")).select("p.*").where("id is not null")
    return p.select(F.col("id").alias("person"), F.coalesce("fullName", F.concat(F.lit("person "), F.col("id").cast("string"))).alias("name"), F.when(F.col("pitchHand.code").isin("L", "R", "S"), F.col("pitchHand.code")).alias("hand"))


def transactions(payloads: DataFrame, text: str = "json", seen: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Moves with an id, a person and a date; the effective date is left aside on purpose. ``place`` orders listings."""
    t = payloads.select((F.col(seen) if seen else F.lit(0)).alias("seen"), F.posexplode(F.from_json(text, TRANSACTIONS)["transactions"]).alias("at", "t")).select("t.*", F.struct("seen", "at").alias("place")).withColumn("day", tolerant_date(F.col("date")))
    t = t.withColumn("reason", F.when(F.col("id").isNull(), "without_id").when(F.col("person.id").isNull(), F.concat(F.lit("without_person:"), F.col("id").cast("string"))).when(F.col("day").isNull(), F.concat(F.lit("without_date:"), F.col("id").cast("string"))))
    team = F.coalesce("toTeam.id", "fromTeam.id")
    return _split(t, "reason", [F.col("id").alias("transaction_id"), F.col("person.id").alias("person"), F.col("person.fullName").alias("name"), F.col("typeCode").alias("type_code"), F.col("typeDesc").alias("type_desc"), "description", F.col("day").alias("transaction_date"), team.alias("team"), "place"], ["id"])
