"""Tables written between the steps of a multi-step operator.

Long plans and loops are cut by writing a table into the folder that the cluster shares among its executors and reading
it again: such a table outlives the loss of any executor.  The folder is the session's ``spark.checkpoint.dir``; only
where that is unset and the session runs in one process (tests) a folder of our own is chosen.

A written table is deleted by ``release`` as soon as no later step reads it, and at the latest when the application ends:
the application's own folder is marked for deletion with the file system.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="geoloom-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes with the application."""
    base = f"{shared_dir(spark)}/geoloom/{spark.sparkContext.applicationId}"
    if base not in _MARKED:
        where, files = file_system(spark, base)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _MARKED.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(path, file system) of the session's own virtual machine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it again: (table, its path)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``cut`` that no later step reads."""
    for p in paths:
        where, files = file_system(spark, p)
        files.delete(where, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
