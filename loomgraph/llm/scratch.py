"""Written intermediate tables: the way these operators cut lineage.

A step whose result is read more than once is written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir`` and read again, so a lost executor costs a re-read and not a
recomputation.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import filesystem, remove, shared_folder


class Scratch:
    """A folder for one call's intermediate tables, removed when the driver's process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, name: str, frame: DataFrame) -> DataFrame:
        """``frame`` written below the scratch folder and read again with the same columns."""
        path = f"{self.root}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            remove(self.spark, f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Remove all tables but those that the result still reads."""
        fs, root = filesystem(self.spark, self.root)
        for entry in fs.listStatus(root) if fs.exists(root) else []:
            if entry.getPath().getName() not in names:
                fs.delete(entry.getPath(), True)

    def close(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session is gone: the cluster's own cleaning of its folder remains
            pass
