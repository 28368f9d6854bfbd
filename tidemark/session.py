"""Sessions with the settings that every plan here counts on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Set on builders and, where Spark allows it, on sessions that others made.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # what a task holds is bounded by the second; the first leaves room for as many tasks as the input then needs
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "480",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # a frame that is kept in memory has as many tasks as its size asks for, not all 480
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def builder(master: str | None = None, name: str = "tidemark") -> SparkSession.Builder:
    made = SparkSession.builder.appName(name)
    for k, v in SETTINGS.items():
        made = made.config(k, v)
    return made.master(master) if master else made


def adopt(spark: SparkSession) -> SparkSession:
    """Brings a session's run-time settings in line: instants are UTC everywhere."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without one a local master gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tidemark-")


#: Whether an execution's shuffle files go when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing, _lock = 0, threading.Lock()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind: nothing reads them once the table is there. Without this they stay on the executors' disks until the driver's
    garbage collector finds their plan. Several threads may be inside; the session's own setting comes back with the last one."""
    global _freeing
    with _lock:
        _freeing += 1
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _lock:
            _freeing -= 1
            if not _freeing:
                spark.conf.unset(_FREE)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what reads it starts a plan anew, and a lost executor costs nothing that was done before."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs that a caller starts side by side.
AT_ONCE = 4


def side_by_side(works: Sequence[Callable], at_once: int = AT_ONCE) -> list:
    """What each function gives, in their order. They run in threads of the driver: where each one plans and runs small jobs, the cluster isn't idle while one plans."""
    with ThreadPoolExecutor(at_once) as pool:
        return [x.result() for x in [pool.submit(w) for w in works]]


_PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: Name of the archive that ships this package to Python workers; one for each driver process.
_SHIPPED = f"tidemark-core-{uuid.uuid4().hex}.zip"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run: the driver serves an archive of it."""
    context = spark.sparkContext
    if any(x.endswith(_SHIPPED) for x in context._python_includes):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), _SHIPPED)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
