"""Projected geometry: vertices, edges, contact with the area.

Small features stay one row and carry their edges as an array: nothing is
shuffled between the scan and the voxel spans. Large ones are cut into chunks
of vertices that spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.functions import planar
from lithogrid.functions.geodesy import project

# Features with more edges than this take the exploded path.
MAX_EDGES_IN_ROW = 64
CHUNK_VERTICES = 4096

def with_outline(features: DataFrame) -> DataFrame:
    """Add ``outline`` (part, ring and length of every ring) and ``n_edges``."""
    outlined = features.withColumn(
        "outline", F.expr("transform(rings, g -> named_struct('part', g.part, 'ring', g.ring, 'n', size(g.lon)))"))
    return outlined.withColumn(
        "n_edges", F.coalesce(F.expr("aggregate(outline, 0, (n, g) -> n + g.n)"), F.lit(0)))


def project_in_row(framed: DataFrame, max_edges: int = MAX_EDGES_IN_ROW) -> DataFrame:
    """Add ``x`` and ``z``: metre arrays over the vertices of all rings in order.

    Empty for features that are not ``usable``, and for those with more than
    ``max_edges`` edges.
    """
    def vertices(field: str):
        return F.expr(f"CASE WHEN usable AND n_edges <= {max_edges} THEN flatten(rings.{field}) "
                      "ELSE cast(array() AS array<double>) END")

    flat = framed.select("*", vertices("lon").alias("_lon"), vertices("lat").alias("_lat"))
    projected = flat.withColumn("_p", project(F.col("_lon"), F.col("_lat"), F.col("lon0"), F.col("lat0")))
    return projected.select("*", "_p.x", "_p.z").drop("_lon", "_lat", "_p")


_OFFSET = "aggregate(slice(outline, 1, k), 0, (n, h) -> n + h.n)"
_EDGE = "named_struct('x1', x[o + i - 1], 'z1', z[o + i - 1], 'x2', x[o + i], 'z2', z[o + i])"
_POINT = "named_struct('x1', x[o], 'z1', z[o], 'x2', x[o], 'z2', z[o])"
_EDGES = f"""
flatten(transform(CASE WHEN size(x) > 0 THEN outline ELSE slice(outline, 1, 0) END, (g, k) ->
  {planar.let('o', _OFFSET, f'''CASE WHEN g.n = 1 THEN array({_POINT})
       ELSE transform(sequence(1, g.n - 1), i -> {_EDGE}) END''')}))"""


def edges_in_row(projected: DataFrame) -> DataFrame:
    """Add ``edges``: ``array<struct<x1, z1, x2, z2>>``; a point is an edge of no length."""
    return projected.withColumn("edges", F.expr(_EDGES))


# Any part of the outline inside, or the area wholly within the polygon.
_CORNER_INSIDE = """geom_type IN ('Polygon', 'MultiPolygon') AND size(filter(edges, e ->
  {crosses} AND {z} < qz[0])) % 2 = 1""".format(
    crosses=f"({planar.crosses('qx[0]')})", z=planar.crossing_z("qx[0]"))
_TOUCHES_AREA = f"""
exists(edges, e -> {planar.STARTS_INSIDE}) OR exists(edges, e -> {planar.MEETS_AREA})
OR ({_CORNER_INSIDE})"""


def touches_area(projected: DataFrame) -> DataFrame:
    """Add ``in_area``: the clipped geometry is not empty."""
    touches = f"size(x) > 0 AND {planar.let('edges', _EDGES, _TOUCHES_AREA)}"
    return projected.withColumn("in_area", F.coalesce(F.expr(touches), F.lit(False)))


# --- large features -----------------------------------------------------------------------------

def chunk_edges(framed: DataFrame, chunk: int = CHUNK_VERTICES) -> DataFrame:
    """Projected edges of large features, one per row.

    Rings are cut into chunks that share one vertex, so edges need no window
    over the ring, and the chunks of one feature go to different tasks.
    """
    carried = ["area_id", "pos", "geom_type", "width", "voxel_size_m", "lon0", "lat0",
               "quad", "qx", "qz", "first_column", "last_column", *[c for c in framed.columns if c == "stride"]]
    step = max(1, chunk)
    pieces = f"""flatten(transform(rings, (g, k) ->
      transform(sequence(1, greatest(1, size(g.lon) - 1), {step}), start -> named_struct(
        'k', k, 'start', start, 'lon', slice(g.lon, start, {step + 1}), 'lat', slice(g.lat, start, {step + 1})))))"""
    chunks = (
        framed.select(*carried, F.explode_outer(F.expr(pieces)).alias("g")).filter("g IS NOT NULL")
        .select(*carried, "g.*")
        .repartition("area_id", "pos", "k", "start")
    )
    local = chunks.withColumn("p", project(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0")))
    edge = "named_struct('x1', p.x[i - 1], 'z1', p.z[i - 1], 'x2', p.x[i], 'z2', p.z[i])"
    point = "named_struct('x1', p.x[0], 'z1', p.z[0], 'x2', p.x[0], 'z2', p.z[0])"
    edges = f"CASE WHEN size(p.x) = 1 THEN array({point}) ELSE transform(sequence(1, size(p.x) - 1), i -> {edge}) END"
    return local.select(*carried, F.explode_outer(F.expr(edges)).alias("e"))


def large_contact(edges: DataFrame) -> DataFrame:
    """Per large feature: ``in_area`` as for small ones, and ``unreachable``."""
    meets = edges.withColumn("f", F.expr(planar.SIDE_VALUES)).withColumn("t", F.expr(planar.INSIDE_RANGE))
    below = f"geom_type IN ('Polygon', 'MultiPolygon') AND ({planar.crosses('qx[0]')})"
    under = F.expr(f"CASE WHEN {below} AND {planar.crossing_z('qx[0]')} < qz[0] THEN 1 ELSE 0 END")
    return (
        meets.groupBy("area_id", "pos")
        .agg(F.bool_or(F.coalesce(F.expr("t.t0 <= t.t1"), F.lit(False))).alias("meets"),
             (F.sum(under) % 2 == 1).alias("around"),
             F.bool_or(F.isnan("e.x1") | F.isnan("e.x2")).alias("unreachable"))
        .select("area_id", "pos", (F.col("meets") | F.col("around")).alias("in_area"), "unreachable")
    )
