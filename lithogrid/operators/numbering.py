"""Running counts over input order, without a window over a whole area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithogrid.operators.lookup import lookup

# Positions per block: the most rows one window partition can hold.
BLOCK_BITS = 20


def with_accepted_before(features: DataFrame, block_bits: int = BLOCK_BITS,
                         broadcast: bool | None = None) -> DataFrame:
    """Add ``accepted_before``: accepted features of the area at earlier positions.

    A prefix sum in two levels. Blocks of consecutive positions are counted
    (combined before the shuffle), the counts are summed up per area, and only
    the rows of one block share a window.
    """
    blocked = features.withColumn("_block", F.shiftright("pos", block_bits))
    accepted = F.when(F.col("accepted"), 1).otherwise(0).cast("bigint")
    counts = blocked.groupBy("area_id", "_block").agg(F.sum(accepted).alias("_n"))
    earlier = W.partitionBy("area_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("area_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = W.partitionBy("area_id", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    running = blocked.withColumn("_before", F.coalesce(F.sum(accepted).over(within), F.lit(0)))
    return (
        lookup(running, offsets, ["area_id", "_block"], broadcast=broadcast)
        .withColumn("accepted_before", F.col("_offset") + F.col("_before"))
        .drop("_block", "_offset", "_before")
    )


def default_id(has_id, given, accepted_before):
    """The given id (an explicit null stays null), else the running count."""
    return F.when(has_id, given).otherwise(accepted_before.cast("string"))
