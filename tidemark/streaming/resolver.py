"""Identity on a stream of captures: each feed row sees what earlier rows of its matchup, and earlier captures, have written.

A capture lands as one JSON file, or as many and then one file that names them. Captures of a micro-batch are taken in order of their instant; each is resolved against the stored
events in sessions of a pair of teams, and then written in three steps that may each be done again: the decisions (a log by
capture), the events that they change, the prices. A capture that comes again, whole or in part, finds its decisions in the log and changes nothing.

A late capture (older than one that was taken before) is resolved too: an id that an event had before still means it, and an id that a
later capture has stamped is never taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.sources import feeds, landing, tables

EVENTS = "event_id string, home string, away string, start_us bigint, odds_id string, stamped_us bigint, former_ids array<string>"
DECISIONS = "captured_us bigint, feed_id string, home string, away string, start_us bigint, place bigint, event_id string, action string"
PRICES = "event_id string, book string, market string, side string, captured_us bigint, price_decimal double, price_american int"
PRICE_KEY = ["event_id", "book", "market", "side", "captured_us"]


def new_id() -> Column:
    """The id of an event that a feed row creates: made from the row's own id, so that it is the same if the capture comes again."""
    return F.concat(F.lit("odds:"), F.col("feed_id"))


def source(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """Captures as they land; at most so many files to a micro-batch."""
    return spark.readStream.schema(landing.LANDED).option("maxFilesPerTrigger", files).json(folder)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The resolver's events, decisions or prices so far."""
    schema = {"events": EVENTS, "decisions": DECISIONS, "prices": PRICES}[name]
    return tables.stored(spark, f"{root}/{name}", schema)


def seed(events: DataFrame, root: str, buckets: int = tables.BUCKETS) -> dict[str, int]:
    """Events that the schedule knows, put into the resolver's table; an id that was stamped stays."""
    known = events.select("event_id", "home", "away", "start_us", *[F.lit(None).cast(t).alias(c) for c, t in (("odds_id", "string"), ("stamped_us", "bigint"), ("former_ids", "array<string>")) if c not in events.columns], *[c for c in ("odds_id", "stamped_us", "former_ids") if c in events.columns])
    return tables.upsert(f"{root}/events", known.select(*[x.split()[0] for x in EVENTS.split(", ")]), ["event_id"], ["event_id"], keep_old=("odds_id", "stamped_us", "former_ids"), buckets=buckets)


def take(capture: DataFrame, root: str, captured_us: int, buckets: int = tables.BUCKETS) -> dict[str, int]:
    """One capture (place, json): its decisions, events and prices written. Gives the decisions' actions and rows of prices."""
    spark = capture.sparkSession
    rows, _ = feeds.odds(capture, keep=("place",))
    priced = rows.where(F.unix_micros("start") > captured_us).drop("last_update").persist()  # games under way are left out; parsed once for decisions and prices
    try:
        live = capture.select(F.get_json_object("json", "$.id").alias("feed_id"))
        feed = priced.groupBy(F.col("id").alias("feed_id")).agg(F.min_by(F.struct(F.col("home_team").alias("home"), F.col("away_team").alias("away"), F.unix_micros("start").alias("start_us")), "place").alias("r"), F.min("place").alias("place"))
        feed = feed.select(F.lit(captured_us).cast("bigint").alias("captured_us"), "feed_id", "r.*", "place")
        log = lambda: table(spark, root, "decisions").where(F.col("captured_us") == captured_us)
        events = table(spark, root, "events")
        new = feed.join(log().select("feed_id"), "feed_id", "left_anti")
        resolved = identity.resolve(new, events, order="place", live=live)
        decided = new.join(resolved, "feed_id").withColumn("event_id", F.coalesce("event_id", new_id()))
        tables.upsert(f"{root}/decisions", decided.select(*[x.split()[0] for x in DECISIONS.split(", ")]), ["captured_us", "feed_id"], ["place"], bucket=F.col("captured_us"))
        made = log()  # what was decided now or before
        tables.upsert(f"{root}/events", identity.writes(made.drop("event_id", "action"), table(spark, root, "events"), made.select("feed_id", "event_id", "action"), new_id()), ["event_id"], ["odds_id"], buckets=buckets)
        found = priced.join(made.select(F.col("feed_id").alias("id"), "event_id"), "id").select("event_id", "book", "market", "side", F.lit(captured_us).cast("bigint").alias("captured_us"), "price_decimal", "price_american")
        prices = tables.upsert(f"{root}/prices", found, PRICE_KEY, ["price_decimal"], bucket=F.col("captured_us"))
        return {r[0]: r[1] for r in made.groupBy("action").count().collect()} | {"prices": prices["inserted"]}
    finally:
        priced.unpersist()


def take_batch(batch: DataFrame, root: str, buckets: int = tables.BUCKETS) -> list[dict]:
    """The captures of a micro-batch in order: few, as the source bounds the files of one."""
    spark, at = batch.sparkSession, F.unix_micros("captured_at")
    parts = F.col("parts") if "parts" in batch.columns else F.lit(None).cast("string")
    batch = batch.withColumn("parts", parts).persist()
    try:
        due = batch.groupBy(at.alias("at")).agg(F.collect_set("parts").alias("parts")).orderBy("at").collect()
        out = []
        for r in due:
            capture = batch.where((at == r.at) & F.col("parts").isNull()).select("place", "json")
            out.append(take(capture.unionByName(spark.read.schema("place bigint, json string").json(sorted(r.parts))) if r.parts else capture, root, r.at, buckets))
        return out
    finally:
        batch.unpersist()


def run(spark: SparkSession, folder: str, root: str, files: int = 8, buckets: int = tables.BUCKETS):
    """All captures that have landed and were not taken yet; the query's progress is kept in root. buckets: of the table of events."""
    stream = source(spark, folder, files).writeStream.foreachBatch(lambda df, _: take_batch(df, root, buckets) and None)
    return stream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
