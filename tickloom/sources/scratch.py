"""A folder that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_marked: set[str] = set()


def _removed_at_end(spark: SparkSession, folder: str) -> None:
    """Make a folder that the driver removes when the application ends; one of a driver that is killed stays."""
    if folder not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(folder)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one that is removed at the end of the application."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        place = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    folder = f"{place.rstrip('/')}/tickloom/{spark.sparkContext.applicationId}"
    _removed_at_end(spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder: later uses read it instead of computing it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
