"""Quality report: one header row per area and its lists in bounded pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0.0"

# Limitation texts of every report.
LIMITATIONS = (
    "Footprint extrusion; no mesh or LiDAR reconstruction",
    "Overlapping feature records require downstream composition",
    "No automatic planning drawing georeferencing",
    "Metric scale is approximate away from local projection origin",
)

# Entries per piece of a list, as positions in input order.
PIECE_BITS = 12


def _per_area(df: DataFrame, **columns) -> DataFrame:
    return df.groupBy("area_id").agg(*[column.alias(name) for name, column in columns.items()])


def crs():
    """PROJ text of the area's local system."""
    return F.concat(F.lit("+proj=aeqd +lat_0="), F.col("lat0").cast("string"), F.lit(" +lon_0="),
                    F.col("lon0").cast("string"), F.lit(" +datum=WGS84 +units=m"))


def headers(framed: DataFrame, voxel_counts: DataFrame, accepted: DataFrame,
            issues: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts and constants per area, and whether the strict gate fails.

    ``voxel_counts`` is (area_id, voxel_records); the other inputs are counted
    here. Everything joined is one row per area.
    """
    def severity(name: str):
        return F.count_if(F.col("severity") == name)

    joined = (
        framed.select("area_id", "voxel_size_m", "lon0", "lat0", "strict")
        .join(voxel_counts, "area_id", "left")
        .join(_per_area(accepted, features=F.count(F.lit(1))), "area_id", "left")
        .join(_per_area(issues, errors=severity("error"), warnings=severity("warning")), "area_id", "left")
        .join(_per_area(skipped, skipped_osm=F.count(F.lit(1))), "area_id", "left")
        .fillna(0, ["voxel_records", "features", "errors", "warnings", "skipped_osm"])
    )
    failed = F.col("strict") & (
        (F.col("errors") + F.col("warnings") + F.col("skipped_osm") > 0) | (F.col("features") == 0))
    return joined.select(
        "area_id",
        F.lit(VERSION).alias("version"),
        "voxel_size_m",
        crs().alias("crs"),
        F.struct(F.lit("east").alias("x"), F.lit("up").alias("y"), F.lit("north").alias("z")).alias("axis"),
        F.col("voxel_records").cast("bigint").alias("voxel_records"),
        "features", "errors", "warnings", "skipped_osm",
        F.array(*[F.lit(text) for text in LIMITATIONS]).alias("limitations"),
        "strict",
        failed.alias("strict_failed"),
    )


def list_pieces(registry: DataFrame, issues: DataFrame, skipped: DataFrame) -> DataFrame:
    """Sources, issues and skipped elements in input order, as JSON entries.

    A list is cut by position, so no row holds more than ``2 ** PIECE_BITS``
    entries even where one area has a third of all of them. The pieces of a
    list, ordered by ``piece``, are the whole list.
    """
    def entries(df: DataFrame, name: str, json) -> DataFrame:
        return df.select("area_id", F.lit(name).alias("list"), "pos", json.alias("entry"))

    reason = F.when(F.col("severity") == "error", F.to_json(F.struct(
        "feature", "severity", F.element_at("reasons", 1).alias("reason")))).otherwise(
        F.to_json(F.struct("feature", "severity", F.col("reasons").alias("reason"))))
    rows = (
        entries(registry, "sources", F.col("raw"))
        .unionByName(entries(issues, "issues", reason))
        .unionByName(entries(skipped, "skipped_osm", F.to_json(F.struct("id", "reason"))))
    )
    return (
        rows.groupBy("area_id", "list", F.shiftright("pos", PIECE_BITS).alias("piece"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "entry"))).alias("e"))
        .select("area_id", "list", "piece", F.col("e.entry").alias("entries"))
    )
