"""Price capture as a stream: micro-batches are deduplicated by key within the watermark and appended; bars by the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import ENTITIES

KEY = ["event_id", "book_id", "market", "side", "captured_at"]


def source(spark: SparkSession, landing: str, schema: str = ENTITIES["odds_snapshots"]) -> DataFrame:
    """Rows that land as JSON files."""
    return spark.readStream.schema(schema).json(landing)


def deduplicated(rows: DataFrame, late: str = "2 hours", key: list[str] | None = None, at: str = "captured_at") -> DataFrame:
    """Each key once; state is dropped once the watermark has passed."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key or KEY)


def bars(rows: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "captured_at") -> DataFrame:
    """Price bars of each outcome and hour: first, last, lowest, highest, count."""
    w = rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_id", "book_id", "market", "side")
    made = w.agg(F.min_by("price_decimal", at).alias("first"), F.max_by("price_decimal", at).alias("last"), F.min("price_decimal").alias("low"), F.max("price_decimal").alias("high"), F.count(F.lit(1)).alias("n"))
    return made.select(F.col("w.start").alias("start"), "event_id", "book_id", "market", "side", "first", "last", "low", "high", "n")


def append(rows: DataFrame, path: str, checkpoint: str):
    """Starts the append of a stream to a Parquet table; every file is written once."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closing(snapshots: DataFrame, starts: DataFrame) -> DataFrame:
    """Q6: the closing price of an outcome is its last capture before the start; all captures are kept."""
    s = snapshots.join(starts.select("event_id", "start"), "event_id").where("captured_at < start")
    return s.groupBy("event_id", "book_id", "market", "side").agg(F.max_by("price_decimal", "captured_at").alias("price_decimal"), F.max("captured_at").alias("captured_at"))
