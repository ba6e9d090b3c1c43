"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Writes stage results as Parquet and reads them back.

    A written table cuts the lineage, survives lost executors and serves later
    stages with only the columns they need. The folder lies under
    ``spark.checkpoint.dir``; where that is unset, only a session with a local
    master gets a temporary one, because executors elsewhere would not see it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="lithogrid-")
        self.path = f"{shared.rstrip('/')}/lithogrid-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the tables; nothing that reads them may run afterwards."""
        delete(self.spark, self.path)


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    store, at = _store(spark, path)
    _, target = _store(spark, to)
    store.mkdirs(target.getParent())
    if not store.rename(at, target):
        raise OSError(f"cannot move {path} to {to}")
