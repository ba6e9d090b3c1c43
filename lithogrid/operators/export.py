"""Clipped features in the local system, as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.functions import planar
from lithogrid.functions.planar import let

_OFFSET = "aggregate(slice(outline, 1, k), 0, (n, h) -> n + h.n)"
_VERTICES = "transform(sequence(o, o + g.n - 1), j -> named_struct('x', x[j], 'z', z[j]))"
_RINGS = (f"transform(outline, (g, k) -> named_struct('part', g.part, 'ring', g.ring, "
          f"'v', {let('o', _OFFSET, _VERTICES)}))")


def _value(k: int, p: str) -> str:
    return planar.side_value(k, f"{p}.x", f"{p}.z")


def _clip_side(k: int) -> str:
    """One half plane of Sutherland-Hodgman over open rings."""
    cut = ("named_struct('x', p.x + (q.x - p.x) * (w.p / (w.p - w.q)), "
           "'z', p.z + (q.z - p.z) * (w.p / (w.p - w.q)))")
    step = let("w", f"named_struct('p', {_value(k, 'p')}, 'q', {_value(k, 'q')})", f"""
      CASE WHEN w.p >= 0 AND w.q >= 0 THEN array(q) WHEN w.p >= 0 THEN array({cut})
           WHEN w.q >= 0 THEN array({cut}, q) ELSE slice(g.v, 1, 0) END""")
    walk = f"flatten(transform(g.v, (p, i) -> {let('q', 'g.v[(i + 1) % size(g.v)]', step)}))"
    return f"transform(clipped, g -> named_struct('part', g.part, 'ring', g.ring, 'v', {walk}))"


def _clip(rings: DataFrame) -> DataFrame:
    """Cut polygon rings at the four sides of the area; rings inside stay as they are.

    Concave outlines may keep pieces joined along the area's border; the
    covered surface is the same.
    """
    opened = rings.withColumn("clipped", F.expr(
        "CASE WHEN NOT areal THEN slice(clipped, 1, 0) WHEN inside THEN clipped ELSE transform(clipped, g -> "
        "named_struct('part', g.part, 'ring', g.ring, 'v', slice(g.v, 1, size(g.v) - 1))) END"))
    for k in (1, 2, 3, 4):
        opened = opened.withColumn("clipped", F.expr(f"CASE WHEN inside THEN clipped ELSE {_clip_side(k)} END"))
    return opened.withColumn("clipped", F.expr(
        "CASE WHEN inside THEN clipped ELSE transform(filter(clipped, g -> size(g.v) > 2), g -> named_struct("
        "'part', g.part, 'ring', g.ring, 'v', concat(g.v, slice(g.v, 1, 1)))) END"))


_XZ = "transform({}, p -> array(p.x, p.z))"
_PART = f"transform(filter(clipped, g -> g.part = k), g -> {_XZ.format('g.v')})"
_PARTS = f"transform(array_sort(array_distinct(clipped.part)), k -> {_PART})"
_SEGMENTS = (f"transform(filter(transform(edges, e -> {planar.CLIPPED_SEGMENT}), s -> s IS NOT NULL), "
             "s -> array(array(s.px, s.pz), array(s.px + s.dx, s.pz + s.dz)))")
_POINTS = f"transform(filter(edges, e -> {planar.STARTS_INSIDE}), e -> array(e.x1, e.z1))"


def _geometry(kind: str, coordinates: str) -> str:
    return f"to_variant_object(named_struct('type', '{kind}', 'coordinates', {coordinates}))"


def local_features(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row with ``x, z, outline, edges, quad``.

    Polygons come as clipped rings, lines as they are when inside and as their
    clipped segments otherwise, each with the distance it is thickened by.
    """
    marked = features.select(
        "*",
        F.expr("geom_type IN ('Polygon', 'MultiPolygon')").alias("areal"),
        F.expr(f"forall(edges, e -> {planar.STARTS_INSIDE} AND {planar.ENDS_INSIDE})").alias("inside"),
        F.expr(_RINGS).alias("whole"),
    )
    cut = _clip(marked.withColumn("clipped", F.col("whole")))
    geometry = F.expr(f"""CASE
      WHEN geom_type = 'Polygon' THEN {_geometry('Polygon', f"get({_PARTS}, 0)")}
      WHEN areal THEN {_geometry('MultiPolygon', _PARTS)}
      WHEN geom_type = 'LineString' AND inside THEN {_geometry('LineString', _XZ.format('whole[0].v'))}
      WHEN geom_type IN ('LineString', 'MultiLineString') THEN {_geometry('MultiLineString', _SEGMENTS)}
      WHEN geom_type = 'Point' THEN {_geometry('Point', f"get({_POINTS}, 0)")}
      ELSE {_geometry('MultiPoint', _POINTS)} END""")
    return cut.select(
        "area_id", "pos",
        F.to_json(F.struct(
            F.lit("Feature").alias("type"), F.col("feature").alias("id"),
            F.col("properties"), geometry.alias("geometry"),
            F.when(F.col("thick"), F.col("width") / 2).alias("buffer_m"))).alias("feature_json"))
