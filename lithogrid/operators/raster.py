"""Footprints and thickened lines to column spans, and spans to voxels.

A span is a run of cells ``z0..z1`` in one grid column ``x`` whose centres lie
in the closed geometry and in the area. Columns are filled from the sorted
crossings of the column's centre line with the outline, so the work is edges
plus output and never cells times edges.

Generators over computed arrays are the outer kind with a filter behind them:
the plain kind makes the optimizer copy the array expression into a filter
below, and evaluate it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithogrid.functions import planar
from lithogrid.operators import columns

_XC = planar.centre("c")
#: Columns of an edge that are made at once.
COLUMN_BLOCK = 1 << 16


def _cells(low: str, high: str) -> str:
    """Cells between two z positions, cut to the area at column ``xc``."""
    return (f"named_struct('z0', greatest({planar.first_cell(low)}, bottom_cell), "
            f"'z1', least({planar.last_cell(high)}, top_cell))")


_CAPSULE_CELLS = _cells(f"({planar.capsule_bottom('xc')})", f"({planar.capsule_top('xc')})")
_BOTTOM_CELL = planar.first_cell(f"({planar.quad_bottom('xc')})")
_TOP_CELL = planar.last_cell(f"({planar.quad_top('xc')})")


def _explode_columns(df: DataFrame, low: str, high: str, keep: list[str]) -> DataFrame:
    """One row per grid column with its centre between two x positions, with its centre line and the area's cells.

    Columns come in blocks, so that no array grows with the grid. With a column
    ``stride`` only the columns that it divides are made.
    """
    stride = "stride" if "stride" in df.columns else "1L"
    first = f"greatest({planar.first_cell(low)}, first_column)"
    first = f"({first} + pmod(-{first}, {stride}))"
    last = f"least({planar.last_cell(high)}, last_column)"
    blocks = f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}, {stride} * {COLUMN_BLOCK}) END"
    kept = [*keep, *(["stride"] if stride == "stride" else [])]
    begun = df.select(*kept, F.expr(last).alias("_last"), F.explode_outer(F.expr(blocks)).alias("_b")).filter("_b IS NOT NULL")
    block = f"sequence(_b, least(_b + {stride} * {COLUMN_BLOCK - 1}, _last), {stride})"
    at = begun.select(*keep, F.explode_outer(F.expr(block)).alias("c")).filter("c IS NOT NULL")
    lined = at.withColumn("xc", F.expr(_XC))
    return lined.select("*", F.expr(_BOTTOM_CELL).alias("bottom_cell"), F.expr(_TOP_CELL).alias("top_cell"))


# --- small features: everything inside the row --------------------------------------------------

def polygon_spans(features: DataFrame, keep: list[str]) -> DataFrame:
    """Spans of polygons from ``edges`` (even-odd, so holes and parts come free).

    Boundaries count as inside: edges that rest on a centre line without
    crossing it add their own cells.
    """
    return columns.spans(features, keep, thick=False)


def thick_spans(features: DataFrame, keep: list[str]) -> DataFrame:
    """Spans of lines and points: cells within half the width of the clipped geometry."""
    return columns.spans(features, keep, thick=True)


# --- large features: edges on the cluster -------------------------------------------------------

def large_polygon_spans(edges: DataFrame) -> DataFrame:
    """Spans of large polygons from exploded edges.

    Every crossing becomes the cell it precedes; crossings of one cell cancel
    in pairs before the shuffle. A crossing exactly on a cell centre also
    closes that cell, as does an edge resting on the centre line.
    """
    sized = edges.withColumnRenamed("voxel_size_m", "r")
    lined = _explode_columns(sized, "least(e.x1, e.x2)", "greatest(e.x1, e.x2)", ["area_id", "pos", "r", "quad", "e"])
    met = lined.select(
        "area_id", "pos", "c", "r", "bottom_cell", "top_cell",
        F.expr(f"CASE WHEN {planar.crosses('xc')} THEN {planar.crossing_z('xc')} END").alias("z"),
        F.expr(f"CASE WHEN {planar.rests_on('xc')} THEN {planar.resting_range('xc')} END").alias("rest"),
    ).filter("z IS NOT NULL OR rest IS NOT NULL")
    cell = f"CASE WHEN z IS NULL THEN {_cells('rest.lo', 'rest.hi')}.z0 " \
           f"ELSE least(greatest({planar.first_cell('z')}, bottom_cell), top_cell + 1) END"
    on_centre = "z / r - 0.5D = floor(z / r - 0.5D) AND floor(z / r - 0.5D) BETWEEN bottom_cell AND top_cell"
    reach = f"CASE WHEN z IS NULL THEN {_cells('rest.lo', 'rest.hi')}.z1 " \
            f"WHEN {on_centre} THEN {planar.last_cell('z')} END"
    marks = met.select(
        "area_id", "pos", "c", F.expr(cell).alias("cell"), F.expr(reach).alias("reach"),
        F.expr("CASE WHEN z IS NULL THEN 0 ELSE 1 END").alias("turn")).filter("turn = 1 OR cell <= reach")
    return _spans_of_marks(marks)


def large_thick_spans(edges: DataFrame) -> DataFrame:
    """Spans of large lines from exploded edges; ranges that begin in one cell merge first."""
    clipped = edges.withColumnRenamed("voxel_size_m", "r").select(
        "area_id", "pos", "r", "quad", "first_column", "last_column", *[c for c in edges.columns if c == "stride"],
        (F.col("width") / 2).alias("radius"), F.expr(planar.CLIPPED_SEGMENT).alias("s"),
    ).filter("s IS NOT NULL").withColumn("s", F.expr(planar.CAPSULE))
    lined = _explode_columns(clipped, "s.west", "s.east", ["area_id", "pos", "r", "quad", "s"])
    cells = lined.select("area_id", "pos", "c", F.expr(_CAPSULE_CELLS).alias("v"))
    marks = cells.filter("v.z0 <= v.z1").select(
        "area_id", "pos", "c", F.col("v.z0").alias("cell"), F.col("v.z1").alias("reach"), F.lit(0).alias("turn"))
    return _spans_of_marks(marks)


def _spans_of_marks(marks: DataFrame) -> DataFrame:
    """Walk up each column: odd turns open and close the inside, ``reach`` adds cells.

    After the aggregate a column has at most one mark per cell of the area, so
    no window partition grows with the number of edges.
    """
    merged = marks.groupBy("area_id", "pos", "c", "cell").agg(
        (F.sum("turn") % 2).alias("turn"), F.max("reach").alias("reach")).filter("turn = 1 OR reach IS NOT NULL")
    column = W.partitionBy("area_id", "pos", "c").orderBy("cell")
    walked = merged.select(
        "area_id", "pos", "c", "cell",
        F.greatest(
            "reach",
            F.when(F.sum("turn").over(column) % 2 == 1, F.lead("cell").over(column) - 1),
        ).alias("z1"),
    )
    below = F.max("z1").over(column.rowsBetween(W.unboundedPreceding, -1))
    return walked.select(
        "area_id", "pos", F.col("c").alias("x"),
        F.greatest("cell", below + 1).alias("z0"), "z1").filter("z0 <= z1")


# --- extrusion ----------------------------------------------------------------------------------

def with_layers(features: DataFrame) -> DataFrame:
    """Add ``y0`` and ``y1`` (exclusive): every layer the feature overlaps at all."""
    low = F.floor(F.col("base") / F.col("voxel_size_m"))
    high = F.ceil((F.col("base") + F.col("height")) / F.col("voxel_size_m"))
    return features.withColumn("y0", low).withColumn("y1", high)


def span_voxels(spans: DataFrame):
    """Voxels a span stands for, as DOUBLE so that no configured height overflows."""
    return (F.col("z1") - F.col("z0") + 1).cast("double") * (F.col("y1") - F.col("y0")).cast("double")


def extrude(spans: DataFrame) -> DataFrame:
    """One row per voxel: cells along the span first, layers last."""
    cells = spans.filter("y0 < y1").withColumn("z", F.explode(F.sequence("z0", "z1")))
    return cells.withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)"))).select(
        "area_id", "x", "y", "z", "kind", "feature", "source")
