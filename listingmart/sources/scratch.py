"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []  # the temporary folder of a local-mode session without the setting
_used: set[str] = set()  # this process's application folders


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir of the session.

    Only a local-mode session may do without the setting; it gets a temporary folder. On a file system that is mounted
    (file:) the folder goes when the driver's process ends; elsewhere its owner drops it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="listingmart-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = f"file://{_own[0]}"
    folder = f"{qualified(spark, root).rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder.startswith("file:") and folder not in _used:
        _used.add(folder)
        atexit.register(shutil.rmtree, "/" + folder.removeprefix("file:").lstrip("/"), True)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """A bare path is of Hadoop's default file system; its scheme tells readers other than Spark."""
    if ":" in path.split("/")[0]:
        return path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, computes once.

    The files outlive lost executors; they stay in a folder of this application's id.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
