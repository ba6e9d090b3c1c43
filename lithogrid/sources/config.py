"""Area configurations and their source registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.functions.values import as_number, is_absent, is_truthy

# Defaults of an area configuration.
DEFAULT_VOXEL_SIZE_M = 1.0
DEFAULT_MAX_AREA_M2 = 4_000_000.0
DEFAULT_MAX_VOXELS = 5_000_000

# The registry entry of OpenStreetMap.
OSM_SOURCE_ID = "osm"
OSM_URL = "https://www.openstreetmap.org/copyright"
OSM_LICENSE = "ODbL-1.0"

CONFIG_SCHEMA = (
    "area_id STRING, bbox ARRAY<DOUBLE>, voxel_size_m VARIANT, max_area_m2 VARIANT, "
    "max_voxels VARIANT, strict BOOLEAN, sources ARRAY<VARIANT>"
)


def read_configs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Configurations as stored; ``area_id`` falls back to the file name.

    ``multiline=False`` reads one configuration per line, which splits.
    """
    raw = spark.read.schema(CONFIG_SCHEMA).option("mode", "FAILFAST").option(
        "multiLine", multiline).json(path)
    file_stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return raw.withColumn("area_id", F.coalesce("area_id", file_stem))


def areas_of(configs: DataFrame) -> DataFrame:
    """One row per area with the defaults filled in."""

    def number(name: str, default: float):
        return F.when(is_absent(F.col(name)), F.lit(float(default))).otherwise(as_number(F.col(name)))

    def corner(i: int):
        return F.when(F.size("bbox") == 4, F.get("bbox", F.lit(i)))

    return configs.select(
        "area_id",
        corner(0).alias("west"),
        corner(1).alias("south"),
        corner(2).alias("east"),
        corner(3).alias("north"),
        number("voxel_size_m", DEFAULT_VOXEL_SIZE_M).alias("voxel_size_m"),
        number("max_area_m2", DEFAULT_MAX_AREA_M2).alias("max_area_m2"),
        number("max_voxels", DEFAULT_MAX_VOXELS).cast("bigint").alias("max_voxels"),
        F.coalesce("strict", F.lit(False)).alias("strict"),
    )


def sources_of(configs: DataFrame) -> DataFrame:
    """Registry entries in listed order, extra metadata kept in ``raw``."""
    entry = F.col("entry")
    return configs.select("area_id", F.posexplode("sources").alias("pos", "entry")).select(
        "area_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.try_variant_get(entry, "$.id", "string").alias("id"),
        F.try_variant_get(entry, "$.url", "string").alias("url"),
        F.try_variant_get(entry, "$.license", "string").alias("license"),
        F.to_json(entry).alias("raw"),
    )


def with_osm_source(sources: DataFrame, areas: DataFrame) -> DataFrame:
    """Append the OpenStreetMap entry to every area, after all listed ones."""
    osm = areas.select(
        "area_id",
        F.lit(2**62).alias("pos"),
        F.lit(OSM_SOURCE_ID).alias("id"),
        F.lit(OSM_URL).alias("url"),
        F.lit(OSM_LICENSE).alias("license"),
        F.to_json(F.struct(F.lit(OSM_SOURCE_ID).alias("id"), F.lit(OSM_URL).alias("url"),
                           F.lit(OSM_LICENSE).alias("license"))).alias("raw"),
    )
    return sources.unionByName(osm)


def registry(sources: DataFrame) -> DataFrame:
    """One row per (area, id): the last entry wins, at the first one's place.

    An aggregate, so duplicates collapse before the shuffle.
    """
    last = F.max_by(F.struct("url", "license", "raw"), "pos")
    return (
        sources.groupBy("area_id", "id")
        .agg(last.alias("last"), F.min("pos").alias("pos"))
        .select("area_id", "id", "pos", "last.url", "last.license", "last.raw",
                (is_truthy(F.col("last.url")) & is_truthy(F.col("last.license"))).alias("complete"))
    )
