"""GeoJSON features and their geometry as arrays of rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithogrid.functions.values import as_text
from lithogrid.operators.lookup import lookup
from lithogrid.plans.workspace import Workspace
from lithogrid.sources.split_json import area_of, read_array

_FEATURE = "id: VARIANT, properties: VARIANT, geometry: VARIANT"

LINE_TYPES = ("LineString", "MultiLineString")
POLYGON_TYPES = ("Polygon", "MultiPolygon")
POINT_TYPES = ("Point", "MultiPoint")
THICKENED_TYPES = ("LineString", "MultiLineString", "Point")


def _identity(column: str):
    """Id as text, and whether there was one at all (an explicit null counts)."""
    return as_text(F.col(column)).alias("id"), F.col(column).isNotNull().alias("has_id")


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection documents, one per area; a document does not split.

    ``area_id`` is the file name without extension, ``pos`` the array position.
    """
    documents = (
        spark.read.schema(f"features ARRAY<STRUCT<{_FEATURE}>>")
        .option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("area_id", area_of("_metadata.file_name"))
    )
    return documents.select("area_id", F.posexplode("features").alias("pos", "f")).select(
        "area_id", F.col("pos").cast("bigint").alias("pos"), *_identity("f.id"),
        "f.properties", "f.geometry")


def read_large_collections(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_collections`, with each document read by as many tasks as it has blocks."""
    found, _ = read_array(spark, path, "features", Workspace(spark).save)
    return features_of(found.withColumn("area_id", area_of("name")))


def features_of(members: DataFrame) -> DataFrame:
    """Features from (area_id, pos, json) of the members of a collection."""
    feature = F.from_json("json", f"STRUCT<{_FEATURE}>", {"mode": "FAILFAST"})
    return members.select("area_id", "pos", feature.alias("f")).select(
        "area_id", "pos", *_identity("f.id"), "f.properties", "f.geometry")


def read_feature_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """One feature per line, with its ``area_id`` member: splits at any size.

    ``pos`` is the line's member of that name if the lines are ``numbered``.
    Otherwise it counts the lines in order of file path and place, whatever
    the splits: the lines of each file block are counted first.
    """
    schema = "area_id STRING, id VARIANT, properties VARIANT, geometry VARIANT"
    reader = spark.read.option("mode", "FAILFAST")
    if numbered:
        lines = reader.schema(f"pos BIGINT, {schema}").json(path)
        return lines.select("area_id", "pos", *_identity("id"), "properties", "geometry")
    lines = reader.schema(schema).json(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")  # one row for each block of a file
    placed = lookup(lines, blocks.withColumn("_before", before), ["_file", "_block"], "inner", spread_by=("_line",))
    return placed.select("area_id", (F.col("_before") + F.col("_line") - F.col("_first")).alias("pos"), *_identity("id"),
                         "properties", "geometry")


# Coordinates of every supported type in the nesting of a MultiPolygon:
# part -> ring -> vertex -> ordinates.
_PARTS = """
CASE geom_type
  WHEN 'Point' THEN array(array(filter(array(try_variant_get(geometry, '$.coordinates', 'array<double>')),
                                       v -> v IS NULL OR size(v) > 0)))
  WHEN 'MultiPoint' THEN transform(
       try_variant_get(geometry, '$.coordinates', 'array<array<double>>'), v -> array(array(v)))
  WHEN 'LineString' THEN array(array(try_variant_get(geometry, '$.coordinates', 'array<array<double>>')))
  WHEN 'MultiLineString' THEN transform(
       try_variant_get(geometry, '$.coordinates', 'array<array<array<double>>>'), v -> array(v))
  WHEN 'Polygon' THEN array(try_variant_get(geometry, '$.coordinates', 'array<array<array<double>>>'))
  WHEN 'MultiPolygon' THEN try_variant_get(geometry, '$.coordinates', 'array<array<array<array<double>>>>')
END"""

# A collection's polygons are its parts; without any, its vertices are, as points.
_MEMBERS = "try_variant_get(geometry, '$.geometries', 'array<variant>')"
_KIND = "try_variant_get(m, '$.type', 'string')"


def _coordinates(depth: int) -> str:
    return f"try_variant_get(m, '$.coordinates', '{'array<' * depth}double{'>' * depth}')"


_MEMBER_POLYGONS = f"""flatten(transform(filter(members, m -> {_KIND} IN ('Polygon', 'MultiPolygon')), m ->
  CASE WHEN {_KIND} = 'Polygon' THEN array({_coordinates(3)}) ELSE {_coordinates(4)} END))"""
_MEMBER_POINTS = f"""transform(flatten(transform(filter(members, m -> {_KIND} NOT IN ('Polygon', 'MultiPolygon')), m ->
  CASE {_KIND} WHEN 'Point' THEN array({_coordinates(1)}) WHEN 'MultiLineString' THEN flatten({_coordinates(3)})
    ELSE {_coordinates(2)} END)), v -> array(array(v)))"""

# A ring is closed when it has just three vertices or ends where it did not begin.
_RINGS = """
filter(flatten(transform(parts, (rs, p) -> transform(rs, (vs, k) -> named_struct(
  'part', p, 'ring', k,
  'lon', transform(vs, v -> get(v, 0)),
  'lat', transform(vs, v -> get(v, 1)))))), g -> g.lon IS NULL OR size(g.lon) > 0)"""
_CLOSED = """
CASE WHEN geom_type IN ('Polygon', 'MultiPolygon') THEN transform(rings, g ->
  CASE WHEN size(g.lon) = 3 OR NOT (get(g.lon, 0) <=> element_at(g.lon, -1)
                                    AND get(g.lat, 0) <=> element_at(g.lat, -1))
  THEN named_struct('part', g.part, 'ring', g.ring,
                    'lon', concat(g.lon, slice(g.lon, 1, 1)), 'lat', concat(g.lat, slice(g.lat, 1, 1)))
  ELSE g END)
ELSE rings END"""
_MALFORMED = """
rings IS NULL OR exists(rings, g -> g.lon IS NULL OR exists(g.lon, v -> v IS NULL)
  OR exists(g.lat, v -> v IS NULL)
  OR (geom_type IN ('LineString', 'MultiLineString') AND size(g.lon) = 1)
  OR (geom_type IN ('Polygon', 'MultiPolygon') AND size(g.lon) < 3))"""


def parse_geometry(features: DataFrame) -> DataFrame:
    """Replace ``geometry`` by ``geom_type``, ``rings`` and ``malformed``.

    ``rings`` is ``array<struct<part, ring, lon, lat>>``; lines and points are
    parts with a single ring. Malformed covers what cannot be constructed at
    all: unknown types, non-numeric ordinates, lines and rings that are too
    short. A geometry collection stands for its polygons, or without any for its
    vertices as points, which are accepted and fill no voxels.
    """
    keep = [c for c in features.columns if c != "geometry"]
    typed = features.withColumn(
        "geom_type", F.try_variant_get("geometry", "$.type", "string"))
    listed = typed.withColumn("members", F.expr(f"CASE WHEN geom_type = 'GeometryCollection' THEN {_MEMBERS} END"))
    parted = listed.withColumn("parts", F.expr(
        f"CASE WHEN geom_type <> 'GeometryCollection' THEN {_PARTS} "
        f"WHEN exists(members, m -> {_KIND} IN ('Polygon', 'MultiPolygon')) THEN {_MEMBER_POLYGONS} ELSE {_MEMBER_POINTS} END"))
    parted = parted.withColumn("geom_type", F.expr(
        "CASE WHEN geom_type <> 'GeometryCollection' THEN geom_type "
        f"WHEN exists(members, m -> {_KIND} IN ('Polygon', 'MultiPolygon')) THEN 'MultiPolygon' ELSE 'MultiPoint' END"))
    ringed = parted.withColumn("rings", F.expr(_RINGS))
    return ringed.select(
        *keep, "geom_type",
        F.expr(_CLOSED).alias("rings"),
        F.coalesce(F.expr(_MALFORMED), F.lit(True)).alias("malformed"),
    )
