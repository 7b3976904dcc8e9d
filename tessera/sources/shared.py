"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's default file system has it."""
    if "://" in path:
        return path.rstrip("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = str(store.makeQualified(place).toString()).rstrip("/")
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may leave it unnamed; it gets a temporary folder, one for each session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return qualified(spark, root)
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _local[name]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows doesn't run its plan a second time."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
