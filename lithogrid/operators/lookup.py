"""Joins to a per-area table, safe for hot areas and for large lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def fits_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Count and weigh at most ``max_rows + 1`` rows."""
    variable = [f.name for f in small.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = 16 * len(small.columns)
    nested = 256 * sum(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in small.schema.fields)
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in variable), F.lit(fixed + nested))
    rows, size = (
        small.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "left",
    spread_by: tuple[str, ...] = ("pos",),
    broadcast: bool | None = None,
) -> DataFrame:
    """Join ``small`` to ``big`` on ``keys`` (null keys find nothing).

    A small side of checked size is broadcast. Otherwise both sides shuffle on
    the keys and a salt taken from ``spread_by``: the rows of a hot key spread
    over ``SALTS`` tasks, the small side is repeated for each.
    """
    if broadcast is None:
        broadcast = fits_broadcast(small)
    if broadcast:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS).cast("bigint")))
    repeated = small.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    # by size of files alone Spark may broadcast either side, however many rows are made of it
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")
