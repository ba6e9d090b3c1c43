"""Kind, source, width, base and height of every feature, with the assumptions made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.functions.values import as_number, as_text, is_absent, is_finite, is_missing, member, parse_float
from lithogrid.operators.lookup import lookup
from lithogrid.sources.geojson import THICKENED_TYPES

# Assumption texts and the kind of a feature that names none.
WIDTH_ASSUMED = "width assumed 1 m"
BASE_ASSUMED = "base elevation assumed 0 m; terrain unavailable"
HEIGHT_ASSUMED = "height assumed 1 m; actual vertical geometry unknown"
HEIGHT_UNREADABLE = "unparseable height; assumed 1 m"
DEFAULT_KIND = "structure"

# Order of the fatal checks within one feature.
FEATURE_STAGE = 5
REPEATED_POSITION = 0
POSITION_TWICE = "Position is used by more than one feature"
UNREGISTERED, UNREADABLE_GEOMETRY, BAD_WIDTH, BAD_ELEVATION, OUT_OF_REACH = 1, 2, 4, 5, 6


def resolve_evidence(features: DataFrame) -> DataFrame:
    """Add ``source_id, kind, width, base, height, assumptions`` and two flags.

    Width exists only for thickened geometry. ``width`` and ``base`` are null
    where a value is present but is no number, which is fatal; an unreadable
    height is an assumption instead.
    """
    named = features.select(
        "*",
        *[member(F.col("properties"), key).alias(f"_{key}")
          for key in ("source_id", "kind", "width_m", "base_elevation_m", "height_m", "height")],
    )
    width, base = F.col("_width_m"), F.col("_base_elevation_m")
    height = F.when(is_absent(F.col("_height_m")), F.col("_height")).otherwise(F.col("_height_m"))
    thick = F.col("geom_type").isin(*THICKENED_TYPES)
    height_text = F.when(F.schema_of_variant(height) != "BOOLEAN", as_text(height))
    height_number = parse_float(F.regexp_replace(height_text, " m$", ""))
    read = named.select(
        *features.columns,
        as_text(F.col("_source_id")).alias("source_id"),
        F.when(is_absent(F.col("_kind")), DEFAULT_KIND).otherwise(as_text(F.col("_kind"))).alias("kind"),
        thick.alias("thick"),
        F.when(thick, F.when(is_missing(width), 1.0).otherwise(as_number(width))).alias("width"),
        F.when(is_absent(base), 0.0).otherwise(as_number(base)).alias("base"),
        F.when(is_missing(height), 1.0).otherwise(height_number).alias("read_height"),
        (thick & is_missing(width)).alias("_no_width"),
        is_absent(base).alias("_no_base"),
        is_missing(height).alias("_no_height"),
    )
    unreadable = F.col("read_height").isNull()
    assumptions = F.array_compact(F.array(
        F.when(F.col("_no_width"), WIDTH_ASSUMED),
        F.when(F.col("_no_base"), BASE_ASSUMED),
        F.when(F.col("_no_height"), HEIGHT_ASSUMED),
        F.when(unreadable, HEIGHT_UNREADABLE),
    ))
    return read.withColumn("height", F.coalesce("read_height", F.lit(1.0))).withColumn(
        "assumptions", assumptions).drop("read_height", "_no_width", "_no_base", "_no_height")


def bad_width():
    return F.col("thick") & ~(is_finite(F.col("width")) & F.coalesce(F.col("width") > 0, F.lit(False)))


def bad_elevation():
    return ~(is_finite(F.col("base")) & is_finite(F.col("height")) & (F.col("height") > 0))


def with_registration(features: DataFrame, registry: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Flag features that cite a registered source; a missing id never does."""
    known = registry.select("area_id", F.col("id").alias("source_id"), F.lit(True).alias("_known"))
    joined = lookup(features, known, ["area_id", "source_id"], broadcast=broadcast)
    return joined.withColumn("registered", F.coalesce("_known", F.lit(False))).drop("_known")


def with_fatal_check(features: DataFrame) -> DataFrame:
    """``fatal``: code of the first failing check, null for a usable feature.

    Geometry errors (``error``) are not fatal and shadow the later checks.
    """
    return features.withColumn(
        "fatal",
        F.when(~F.col("registered"), UNREGISTERED)
        .when(F.col("malformed"), UNREADABLE_GEOMETRY)
        .when(F.col("error").isNotNull(), F.lit(None).cast("int"))
        .when(bad_width(), BAD_WIDTH)
        .when(bad_elevation(), BAD_ELEVATION),
    )


def with_reach_check(checked: DataFrame) -> DataFrame:
    """Usable features with a vertex whose geodesic from the centre is not determined."""
    return checked.withColumn("fatal", F.when(
        F.col("fatal").isNull() & F.col("error").isNull() & F.col("unreachable"), OUT_OF_REACH
    ).otherwise(F.col("fatal")))


def feature_violations(checked: DataFrame) -> DataFrame:
    """Fatal features in the form of the other gates."""
    name = F.coalesce("id", F.concat(F.lit("#"), F.col("pos").cast("string")))
    message = (
        F.when(F.col("fatal") == UNREGISTERED, F.concat(F.lit("Feature "), name, F.lit(" has no registered source")))
        .when(F.col("fatal") == UNREADABLE_GEOMETRY, F.concat(F.lit("Unreadable geometry on "), name))
        .when(F.col("fatal") == BAD_WIDTH, F.concat(F.lit("Invalid width on "), name))
        .when(F.col("fatal") == OUT_OF_REACH, F.concat(F.lit("Vertex opposite the area on "), name))
        .otherwise(F.concat(F.lit("Invalid elevation or height on "), name))
    )
    return checked.filter("fatal IS NOT NULL").select(
        "area_id", F.lit(FEATURE_STAGE).alias("stage"), "pos", F.col("fatal").alias("code"),
        message.alias("message"))


def repeated_positions(features: DataFrame) -> DataFrame:
    """Positions that do not name one feature of their area, in the form of the other gates."""
    counted = features.groupBy("area_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 1").select(
        "area_id", F.lit(FEATURE_STAGE).alias("stage"), "pos", F.lit(REPEATED_POSITION).alias("code"),
        F.lit(POSITION_TWICE).alias("message"))


def issues_of(checked: DataFrame) -> DataFrame:
    """One row per feature with an error, or with assumptions."""
    is_error = F.col("error").isNotNull()
    return checked.filter(
        F.col("fatal").isNull() & (is_error | (F.size("assumptions") > 0))
    ).select(
        "area_id", "pos", F.col("id").alias("feature"),
        F.when(is_error, "error").otherwise("warning").alias("severity"),
        F.when(is_error, F.array("error")).otherwise(F.col("assumptions")).alias("reasons"),
    )
