"""Files in the stores that executors reach, and the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
FALLBACK_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder if all runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{FALLBACK_SHARED}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a table in the shared folder: its lineage ends there, and it outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(path: str):
    """The file system of a URI (or an absolute path) and the path in it, as executors use it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def listed(spark: SparkSession, pattern: str, folders: bool = False) -> list[tuple[str, int]]:
    """URI and size of what a pattern matches, in any store that Spark reads, in text order; none where its folder is absent."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isDirectory() == folders)
