"""Scalar expressions with the semantics of evidence values: loose numbers,
truthiness, and the difference between an absent and a null property."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings accepted as a number.
DECIMAL_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
INFINITE_NUMBER = r"(?i)^[+-]?inf(inity)?$"
NOT_A_NUMBER = r"(?i)^[+-]?nan$"


def parse_float(text: Column) -> Column:
    """Number written in ``text``, null when it is not one.

    Narrower than a cast (no ``3d``, ``0x1p3``) and wider too (``1_000``,
    surrounding white space).
    """
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    infinity = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(bare.rlike(DECIMAL_NUMBER), F.regexp_replace(bare, "_", "").try_cast("double"))
        .when(bare.rlike(INFINITE_NUMBER), infinity)
        .when(bare.rlike(NOT_A_NUMBER), F.lit(float("nan")))
    )


def is_finite(number: Column) -> Column:
    """True for ordinary numbers; false for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def is_truthy(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def member(bag: Column, key: str) -> Column:
    """One property as VARIANT; SQL null means absent."""
    return F.try_variant_get(bag, f"$.{key}", "variant")


def is_absent(value: Column) -> Column:
    return value.isNull()


def is_missing(value: Column) -> Column:
    """Absent or an explicit JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_text(value: Column) -> Column:
    """Text of a VARIANT; objects and arrays come out as their JSON."""
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column) -> Column:
    """Number in a property: JSON numbers, booleans as 1 and 0, numeric text."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", parse_float(as_text(value)))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"),
              F.try_variant_get(value, "$", "double"))
    )
