"""What the operators of this subpackage share: worker imports, Arrow batches, scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that holds whole texts: whichever bound comes first ends it.
TEXT_BATCH, TEXT_BYTES = 512, 32 << 20

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Name of the zip file that ships this package; one for each driver process.
_SHIPPED = f"tidemark-{uuid.uuid4().hex}.zip"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, and keep Arrow batches of whole texts small."""
    context = spark.sparkContext
    if not any(x.endswith(_SHIPPED) for x in context._python_includes):
        path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), _SHIPPED)  # the driver serves it to executors
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(_PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
        context.addPyFile(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a folder of
    its own, and a cluster an error: a folder of one machine would be lost with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor costs nothing that was done before, and the plan that reads them
    starts anew (a checkpoint would carry on the plan's size estimate, which grows without bound when a loop joins tables with themselves)."""
    return stored(df, "cut", "lz4")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read again; columns are kept, and read back one by one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.tidemark_path = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` or ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("tidemark_path")
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def raw_texts(col: pa.Array) -> list[bytes]:
    """The UTF-8 of an Arrow string column; null counts as empty."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
