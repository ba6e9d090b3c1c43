"""Helpers of the corpus operators: shared tables, hot keys, state of a Python worker."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than this share of the rows are hot; there are fewer of them than this number.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """Stage tables as Parquet in the folder that ``spark.checkpoint.dir`` names.

    A written table cuts the lineage and outlives lost executors. Only a local
    session without that setting gets a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="llm-")
        self.spark = spark
        self.path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """Write and read back; one folder for each value of the columns ``folders``."""
        df.write.partitionBy(*folders).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def join_by_size(big: DataFrame, small: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``small``, unique by ``key``, to ``big`` without hot tasks.

    ``small[size]`` counts the rows of ``big`` by key and sums to at most
    ``total``. Keys with more than ``total / HOT_SHARE`` rows are fewer than
    HOT_SHARE, so their rows of ``small`` are broadcast; the others meet in a
    shuffle, where rows already served are dealt out by ``spread``.
    """
    limit = total // HOT_SHARE
    values = [c for c in small.columns if c != key]
    hot = small.filter(F.col(size) > limit).select(key, F.struct(*values).alias("_hot"))
    cold = small.filter(F.col(size) <= limit).select(
        F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("_deal"), F.struct(*values).alias("_cold"))
    dealt = big.join(F.broadcast(hot), key, "left").withColumn(
        "_to", F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(
            F.lit(1).cast("bigint") + F.pmod(F.xxhash64(spread), F.lit(1 << 40))))
    met = dealt.join(cold, (F.col(key) == F.col("_key")) & (F.col("_to") == F.col("_deal")), "left")
    found = F.coalesce("_hot", "_cold")
    return met.select(*big.columns, *[found[c].alias(c) for c in values])


def per_worker(kind: str, key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task until it needs one of another kind or key.

    A worker serves one operator after the other, so what the last one kept is
    let go: a worker never holds more than one such object.
    """
    store = sys.__dict__.setdefault("_llm_per_worker", {})
    if store.get("key") != (kind, key):
        store.clear()
        store["object"] = make()
        store["key"] = (kind, key)
    return store["object"]
