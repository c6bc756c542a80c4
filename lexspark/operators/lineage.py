"""Cutting lineage through the folder that all executors share, and spreading small inputs over cores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own; on a cluster the
    setting is required, because a driver's temporary folder is invisible to executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="spark-lexspark-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back.

    The result survives lost executors and is computed once however often it is read. The files go
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = folder(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settled_by(df: DataFrame, key: str, name: str = "table") -> Iterator[DataFrame]:
    """df written once in buckets of its long column key, under the shared folder, while the block runs.

    One shuffle deals it out by key; joins on key then shuffle their other side only. The files and the
    table's name go when the block ends.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lexspark_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew over all cores where it is read from fewer files than there are cores.

    For steps that need much time a row. A file with a single row group is one task's work, whatever its
    splits. Tables of many files stay as they are, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df._jdf.inputFiles()) < cores else df  # names stay in the JVM


def folder(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = folder(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, files = folder(spark, path)
    files.delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, name)
