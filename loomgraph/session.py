"""Session helpers: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own is set for a local master; on a cluster that is an error,
    because no folder of one machine is seen by all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"

    def close() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaning of its folder remains
            pass

    atexit.register(close)
    return path


def filesystem(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.sc().hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


class Steps:
    """Written steps of an iteration; the folder goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, new_folder(spark, "steps"), 0

    def keep(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        frame.write.parquet(f"{self.root}/{self.count}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{self.count}")
