"""Cutting lineage through written tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LARGE = 32 << 20  # bytes of a stored table after which shuffle files are looked for


def work_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only where the session names none and runs in this one process (a test, a
    trial) is a folder made; on a cluster each executor would write to a disk of
    its own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cuematch-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared folder."""
    return f"{work_dir(spark)}/cuematch-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder where Spark's file systems find it; a missing one is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written for itself; their readers are done."""
    delete(spark, run_dir(spark))


def free_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of queries that nothing refers to any more.

    Spark does so after a collection in the driver, which by itself may come long
    after the disks are full.
    """
    spark._jvm.System.gc()


def _free_after(spark: SparkSession, path: str) -> None:
    """:func:`free_shuffles` where a large table has been written: what it was made from is no longer needed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    if size >= _LARGE:
        free_shuffles(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet and read them back.

    A table in the shared folder survives the loss of executors, and later
    readers prune its columns. :func:`clear` removes them.
    """
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _free_after(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Within it, wide projections are split where one method would be beyond what the JIT compiles.

    Only for actions inside; the session has its own setting back afterwards.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(table: DataFrame) -> DataFrame:
    """A table just read, spread over all cores when it comes in fewer pieces.

    For costly work per row on a small file. A large table already comes in
    many pieces and is left as it is. Only for plain scans: finding the number
    of pieces plans the query.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
