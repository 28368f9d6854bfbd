"""Tables: reading with typed-empty fallback, and writers that append, ignore or let the latest win."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import ENTITIES


def instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become UTC instants (the session's zone is UTC)."""
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table; columns are pruned and filters pushed down by the plan that uses it."""
    return instants(spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet"))


def read_or_empty(spark: SparkSession, root: str, name: str, notes: list[str] | None = None) -> DataFrame:
    """The table, or an empty one of its entity's type with a note: a missing archive degrades, it doesn't fail."""
    try:
        return read(spark, root, name)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if notes is not None:
            notes.append(f"{name}: not there, taken as empty")
        return spark.createDataFrame([], ENTITIES[name])


def insert_ignore(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence = ()) -> DataFrame:
    """Rows of the batch that an insert-or-ignore would add: one for each key (the first by order), none that exists."""
    first = batch.dropDuplicates(list(keys)) if not order else first_of(batch, keys, order)
    return first.join(existing.select(*keys), list(keys), "left_anti")


def latest_wins(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence, keep_old: Sequence[str] = ()) -> DataFrame:
    """The table after an upsert: within the batch the last row by order wins, over the table the batch wins;
    columns in keep_old take the new value only if it is known."""
    last = first_of(batch, keys, order)
    new = last.select([F.struct(*[F.col(c) for c in existing.columns]).alias("__new"), *[F.col(k) for k in keys]])
    both = existing.select([F.struct(*[F.col(c) for c in existing.columns]).alias("__old"), *[F.col(k) for k in keys]]).join(new, list(keys), "full")
    value = lambda c: F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}")) if c in keep_old else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*[(F.col(c) if c in keys else value(c)).alias(c) for c in existing.columns])


#: Buckets of a stored table: a batch rewrites those that it touches. Choose as many as let one bucket fit a task.
BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _move_in(spark: SparkSession, path: str, column: str) -> None:
    """Second half of an upsert: what was staged whole replaces its buckets. Done again after a failure it gives the same table."""
    staged = f"{path}.staged"
    if exists(spark, f"{staged}/_SUCCESS"):
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    if exists(spark, staged):
        fs, at = _folder(spark, staged)
        fs.delete(at, True)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table that ``upsert`` keeps; an empty table of the schema before its first batch."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def upsert(path: str, batch: DataFrame, keys: Sequence[str], order: Sequence, keep_old: Sequence[str] = (), buckets: int = BUCKETS, bucket: Column | None = None) -> dict[str, int]:
    """A batch put into a stored table: within the batch the last row by order wins, over the table the batch wins, columns in keep_old take
    known values alone. Gives the numbers of rows inserted, updated and unchanged.

    The table is laid out by buckets of the keys, or by ``bucket``, an expression that rows of one key share (such as a capture). Only buckets with an
    inserted or updated row are read whole and rewritten; all other files stay as they are, so a batch that comes again writes nothing. New
    buckets are staged whole before they replace old ones: a run that broke off in between is finished by the next one."""
    spark = batch.sparkSession
    column = "in_bucket" if bucket is not None else f"bucket_{buckets}"
    _move_in(spark, path, column)
    where = bucket.cast("string") if bucket is not None else F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    last = first_of(batch, keys, order).withColumn(column, where).persist()
    try:
        columns = [c for c in batch.columns]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema)
        now = stored(spark, path, schema)
        touched = [r[0] for r in last.select(column).distinct().collect()]  # as many as there are buckets at most
        now = now.where(F.col(column).isin(touched)) if touched else now.limit(0)
        old = now.select(*keys, F.struct(*columns).alias("__old"))
        new = [F.coalesce(F.col(c), F.col(f"__old.{c}")) if c in keep_old else F.col(c) for c in columns]
        met = last.join(old, list(keys), "left").select(column, F.col("__old").isNull().alias("__in"), (~F.struct(*[x.alias(c) for x, c in zip(new, columns)]).eqNullSafe(F.col("__old"))).alias("__up"))
        counts = met.groupBy(column).agg(F.count_if("__in").alias("inserted"), F.count_if(~F.col("__in") & F.col("__up")).alias("updated"), F.count(F.lit(1)).alias("n")).collect()
        changed = [r[column] for r in counts if r["inserted"] + r["updated"]]
        total = {k: sum(r[k] for r in counts) for k in ("inserted", "updated")}
        if changed:
            mine = F.col(column).isin(changed)
            full = latest_wins(now.where(mine).select(*columns), last.where(mine).select(*columns), keys, [F.lit(1)], keep_old).withColumn(column, where)
            # a bucket is few files, but not one task, however large it is
            full.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(f"{path}.staged")
            _move_in(spark, path, column)
        return total | {"unchanged": sum(r["n"] for r in counts) - sum(total.values())}
    finally:
        last.unpersist()


def first_of(batch: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key: the first by order."""
    return batch.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def replace_groups(existing: DataFrame, batch: DataFrame, group: Sequence[str]) -> DataFrame:
    """Forced reload: groups that the batch holds are replaced whole, others (also those whose parse came out empty) stay."""
    return existing.join(batch.select(*group).distinct(), list(group), "left_anti").unionByName(batch.select(*existing.columns))


def seeded(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with seed rows added where their keys are missing."""
    return existing.unionByName(insert_ignore(existing, rows.select(*existing.columns), keys))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: columns take the source's value where a row with the same keys exists and the value is known."""
    new = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])
