"""OpenStreetMap extracts (Overpass JSON already on storage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.functions.values import is_truthy
from lithogrid.plans.workspace import Workspace
from lithogrid.sources.split_json import area_of, read_array

ELEMENT = (
    "type: STRING, id: BIGINT, tags: MAP<STRING, STRING>, "
    "bounds: STRUCT<minlon: DOUBLE, minlat: DOUBLE, maxlon: DOUBLE, maxlat: DOUBLE>, "
    "geometry: ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>"
)

# Reasons of skipped elements.
NOT_A_WAY = "multipolygon requires curated geometry"
NO_GEOMETRY = "missing geometry"
INCOMPLETE = "Overpass returned incomplete data: "


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """Extract documents, one per area, with a ``remark`` when incomplete."""
    return (
        spark.read.schema(f"remark STRING, elements ARRAY<STRUCT<{ELEMENT}>>")
        .option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("area_id", area_of("_metadata.file_name"))
    )


def _tagged(elements: DataFrame) -> DataFrame:
    return elements.select("area_id", F.col("pos").cast("bigint").alias("pos"), "e.*").withColumn(
        "tags", F.coalesce("tags", F.expr("map()").cast("map<string, string>")))


def elements_of(extracts: DataFrame) -> DataFrame:
    return _tagged(extracts.select("area_id", F.posexplode("elements").alias("pos", "e")))


def read_large_extracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extract documents that many tasks read each: (area_id, remark) and the elements, as :func:`elements_of` gives them."""
    found, values = read_array(spark, path, "elements", Workspace(spark).save, also=("remark",))
    element = F.from_json("json", f"STRUCT<{ELEMENT}>", {"mode": "FAILFAST"})
    remark = F.from_json(F.concat(F.lit('{"remark":'), "json", F.lit("}")), "remark STRING")["remark"]
    return (values.select(area_of("name"), remark.alias("remark")),
            _tagged(found.select(area_of("name"), "pos", element.alias("e"))))


def incomplete_extracts(extracts: DataFrame) -> DataFrame:
    """A truthy remark voids the whole extract."""
    return extracts.filter(is_truthy(F.col("remark"))).select(
        "area_id", F.lit(0).alias("stage"), F.lit(-1).cast("bigint").alias("pos"), F.lit(0).alias("code"),
        F.concat(F.lit(INCOMPLETE), "remark").alias("message"))


# Liang-Barsky: does the segment p -> q meet the box?
_SEGMENT_MEETS_BOX = """
exists(sequence(1, size(geometry) - 1), i ->
  exists(array(named_struct(
    'x', geometry[i - 1].lon, 'y', geometry[i - 1].lat,
    'dx', geometry[i].lon - geometry[i - 1].lon, 'dy', geometry[i].lat - geometry[i - 1].lat)), s ->
    (s.dx <> 0 OR s.x BETWEEN west AND east) AND (s.dy <> 0 OR s.y BETWEEN south AND north) AND
    greatest(0D,
      CASE WHEN s.dx > 0 THEN (west - s.x) / s.dx WHEN s.dx < 0 THEN (east - s.x) / s.dx END,
      CASE WHEN s.dy > 0 THEN (south - s.y) / s.dy WHEN s.dy < 0 THEN (north - s.y) / s.dy END)
    <= least(1D,
      CASE WHEN s.dx > 0 THEN (east - s.x) / s.dx WHEN s.dx < 0 THEN (west - s.x) / s.dx END,
      CASE WHEN s.dy > 0 THEN (north - s.y) / s.dy WHEN s.dy < 0 THEN (south - s.y) / s.dy END)))"""


def select_elements(elements: DataFrame) -> DataFrame:
    """Ways, and multipolygon relations, that reach into the area's box.

    Needs ``west, south, east, north`` on every row. Ways are tested segment by
    segment; relations by their bounds.
    """
    way = (F.col("type") == "way") & F.when(
        F.size("geometry") >= 2, F.expr(_SEGMENT_MEETS_BOX)).otherwise(F.expr(
            "exists(geometry, p -> p.lon BETWEEN west AND east AND p.lat BETWEEN south AND north)"))
    relation = (
        (F.col("type") == "relation")
        & (F.try_element_at("tags", F.lit("type")) == "multipolygon")
        & F.expr("bounds.minlon <= east AND bounds.maxlon >= west "
                 "AND bounds.minlat <= north AND bounds.maxlat >= south")
    )
    return elements.filter(way | relation)


def _tag(key: str):
    return F.try_element_at("tags", F.lit(key))


def classify(elements: DataFrame) -> DataFrame:
    """Kind of every element from its tags; elements without one are dropped.

    Later rules override earlier ones, so the chain is tested from the last.
    """
    kind = (
        F.when(is_truthy(_tag("attraction")) | is_truthy(_tag("roller_coaster")), "attraction")
        .when(_tag("natural") == "water", "water")
        .when(_tag("amenity") == "parking", "parking")
        .when(F.map_contains_key("tags", "building"), "building")
        .when(F.map_contains_key("tags", "highway"), "path")
        .when(F.map_contains_key("tags", "waterway"), "water")
    )
    return elements.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def with_skip_reason(classified: DataFrame) -> DataFrame:
    too_short = F.coalesce(F.size("geometry"), F.lit(0)) < 2
    return classified.withColumn(
        "skip_reason",
        F.when(F.col("type") != "way", NOT_A_WAY).when(too_short, NO_GEOMETRY))


def skipped_elements(classified: DataFrame) -> DataFrame:
    return with_skip_reason(classified).filter(F.col("skip_reason").isNotNull()).select(
        "area_id", "pos", "id", F.col("skip_reason").alias("reason"))


_IS_RING = """size(geometry) >= 4 AND geometry[0] = element_at(geometry, -1)
              AND kind NOT IN ('path', 'attraction')"""


def osm_features(classified: DataFrame) -> DataFrame:
    """Features of the ways: tags become properties, provenance is stamped on.

    Closed ways are polygons unless they are paths or attractions.
    """
    stamped = F.map_concat(
        F.map_filter("tags", lambda k, _: ~k.isin("kind", "source_id")),
        F.create_map(F.lit("kind"), F.col("kind"), F.lit("source_id"), F.lit("osm")),
    )
    kept = with_skip_reason(classified).filter(F.col("skip_reason").isNull())
    return kept.select(
        "area_id",
        "pos",
        F.concat(F.lit("osm/way/"), "id").alias("id"),
        F.lit(True).alias("has_id"),
        F.to_variant_object(stamped).alias("properties"),
        F.expr(f"CASE WHEN {_IS_RING} THEN 'Polygon' ELSE 'LineString' END").alias("geom_type"),
        F.expr("array(named_struct('part', 0, 'ring', 0, 'lon', geometry.lon, 'lat', geometry.lat))")
        .alias("rings"),
        F.lit(False).alias("malformed"),
    )
