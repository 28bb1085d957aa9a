"""Session helpers: a tuned builder and shared working storage for staged data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "movekit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The storage every executor can reach, named by ``spark.checkpoint.dir``.

    A private temporary folder is only ever used in local mode, where driver and
    executors are one process; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared storage; the caller's job owns it."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders that :func:`stage` wrote in this process, in order, for callers that know when theirs are read no more.
STAGED: list[str] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and return a scan of the written table.

    Cuts the lineage in a way that survives executor loss, and gives the optimizer the
    exact size of the data, so it can decide on a broadcast from a measured bound.
    """
    path = scratch(df.sparkSession, label)
    STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df``, to meet other rows by a shuffle of both sides and never as a broadcast.

    Spark guesses the size of a table from its compressed files and takes no notice of rows that ``explode`` makes,
    so a table that grows with the data can be taken for a small one and pass whole through the driver.
    """
    return df.hint("merge")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path, from one listing of its Hadoop file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return [x.getPath().getName() for x in found if x.isDirectory()]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its Hadoop file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of a Hadoop file system with all below it; a missing one is fine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
