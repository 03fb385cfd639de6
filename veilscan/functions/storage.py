"""How rows lie: spread over tasks, and kept so that a costly result is
computed once and survives the loss of executors."""

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the cluster shares. Only a
    local run, where every task sees the driver's disk, may go without."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured and current is None:
        context.setCheckpointDir(configured)
    elif not configured and current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there. The cluster
    deletes it with the last reference when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as the
    package's session settings do.

    A checkpoint computes its table once to count it and once more to write it:
    the first time also keeps it on the executors' disks for the second. What an
    executor takes along when it is lost is computed again."""
    if df.isStreaming:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.storageLevel
    if kept.useMemory or kept.useDisk:  # by the caller, whose it is to end that
        return df.checkpoint(eager=True)
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over ``spark.sql.shuffle.partitions`` tasks, at least
    two for each core.

    A row group of a file is read by one task, however many splits the file has,
    and a million narrow rows fit into one. Call this on what was read, before
    texts are built of it or scanned, where that costs far more than reading."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores))
