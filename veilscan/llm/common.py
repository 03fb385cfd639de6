"""What the operators share: session preparation, tables kept in the shared
folder, and running Arrow functions over text."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilscan.functions.storage import ensure_checkpoint_dir
from veilscan.session import ship

#: Java class of the word separators in all contracts.
WORD = "[^\\x20\\x09-\\x0D]+"
SEPARATORS = "[\\x20\\x09-\\x0D]+"

#: Rows per Arrow batch: texts may be long, so a batch is kept short.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers, keep Arrow batches small, and let
    shuffle files go when the query that wrote them has ended (what is needed
    again is kept as a table)."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the cluster's checkpoint folder and read
    from there: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(tables: list[DataFrame]) -> None:
    """Delete tables that ``keep`` wrote, once all that reads them has run, and
    empty the list."""
    while tables:
        table = tables.pop()
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return memory that this process no longer uses to the system: workers
    live on between tasks, and the driver between queries."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow function that takes over no memory of the task before it and
    leaves none behind."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped
