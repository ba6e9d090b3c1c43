"""Local coordinate system, outline and gates of every area; pairing of features with areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.functions import planar
from lithogrid.functions.geodesy import project
from lithogrid.functions.values import is_finite
from lithogrid.operators.lookup import fits_broadcast, lookup

# Columns that features need from their area.
FRAME = ["voxel_size_m", "lon0", "lat0", "quad", "qx", "qz", "first_column", "last_column"]

# Messages of the area gates.
BAD_BBOX = "bbox must be west,south,east,north; antimeridian areas must be split"
BAD_RESOLUTION = "voxel_size_m must be positive"
AREA_OVER_BUDGET = "Area exceeds configured build budget; split into smaller areas"
BAD_SOURCE = "Every source needs url and license"
BBOX_CHECK, RESOLUTION_CHECK, AREA_CHECK, SOURCE_CHECK = 1, 2, 3, 4

# Gates on the inputs as a whole; they come before all others.
INPUT_CHECK = 0
REPEATED_AREA, UNKNOWN_AREA = 1, 2
AREA_TWICE = "Area is configured more than once"
NO_SUCH_AREA = "Input names an area that is not configured"
SOURCE_WITHOUT_ID = "Every source needs an id"
NO_POSITION = -1


def frame_areas(areas: DataFrame) -> DataFrame:
    """Add the local system: centre, projected corners, half planes, size, columns.

    The corners of the box are projected and joined by straight lines, so the
    outline is a quadrilateral and not a rectangle.
    """
    centred = areas.select(
        "*",
        ((F.col("west") + F.col("east")) / 2).alias("lon0"),
        ((F.col("south") + F.col("north")) / 2).alias("lat0"),
    )
    corners = project(F.array("west", "east", "east", "west"), F.array("south", "south", "north", "north"),
                      F.col("lon0"), F.col("lat0"))
    outlined = centred.withColumn("c", corners).select("*", "c.x", "c.z").drop("c")
    outlined = outlined.withColumnsRenamed({"x": "qx", "z": "qz", "voxel_size_m": "r"})
    return outlined.select(
        "*",
        F.expr(planar.quad_of("qx", "qz")).alias("quad"),
        F.expr(f"abs({planar.shoelace('qx', 'qz')})").alias("area_m2"),
        F.expr(f"CASE WHEN r > 0 THEN {planar.first_cell('array_min(qx)')} END").alias("first_column"),
        F.expr(f"CASE WHEN r > 0 THEN {planar.last_cell('array_max(qx)')} END").alias("last_column"),
    ).withColumnRenamed("r", "voxel_size_m")


def bbox_is_valid():
    """Ordered box within the world; NaN sorts above every number, so test it."""
    ordered = F.expr("-180 <= west AND west < east AND east <= 180 AND -90 < south AND south < north AND north < 90")
    nan = F.isnan("west") | F.isnan("south") | F.isnan("east") | F.isnan("north")
    return F.coalesce(ordered & ~nan, F.lit(False))


def resolution_is_valid():
    return is_finite(F.col("voxel_size_m")) & (F.col("voxel_size_m") > 0)


def area_violations(framed: DataFrame) -> DataFrame:
    """Box, resolution and area-budget gates, first failing gate per area."""
    stage = (
        F.when(~bbox_is_valid(), BBOX_CHECK)
        .when(~resolution_is_valid(), RESOLUTION_CHECK)
        .when(~F.coalesce(F.col("area_m2") <= F.col("max_area_m2"), F.lit(False)), AREA_CHECK)
    )
    message = F.element_at(
        F.array(F.lit(BAD_BBOX), F.lit(BAD_RESOLUTION), F.lit(AREA_OVER_BUDGET)), F.col("stage"))
    return framed.withColumn("stage", stage).filter("stage IS NOT NULL").select(
        "area_id", "stage", F.lit(NO_POSITION).cast("bigint").alias("pos"), F.lit(0).alias("code"),
        message.alias("message"))


def source_violations(registry: DataFrame) -> DataFrame:
    """Sources without an id, an address or a license."""
    return registry.filter(~F.col("complete") | F.col("id").isNull()).select(
        "area_id", F.lit(SOURCE_CHECK).alias("stage"), F.lit(NO_POSITION).cast("bigint").alias("pos"),
        F.lit(0).alias("code"), F.when(F.col("id").isNull(), SOURCE_WITHOUT_ID).otherwise(BAD_SOURCE).alias("message"))


def input_violations(areas: DataFrame, *inputs: DataFrame) -> DataFrame:
    """Areas configured twice, and area ids of inputs (or null ones) that are not configured."""
    def listed(df: DataFrame, code: int, message: str) -> DataFrame:
        return df.select(
            "area_id", F.lit(INPUT_CHECK).alias("stage"), F.lit(NO_POSITION).cast("bigint").alias("pos"),
            F.lit(code).alias("code"), F.lit(message).alias("message"))

    counted = areas.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    found = listed(counted.filter("n > 1"), REPEATED_AREA, AREA_TWICE)
    for rows in inputs:
        cited = rows.select("area_id").distinct()
        found = found.unionByName(listed(cited.join(counted, "area_id", "left_anti"), UNKNOWN_AREA, NO_SUCH_AREA))
    return found.distinct()


def attach_frame(features: DataFrame, framed: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Give every feature its area's local system; ``input_violations`` lists those of unknown areas."""
    return lookup(features, framed.select("area_id", *FRAME), ["area_id"], "inner", broadcast=broadcast)


# --- pairing ------------------------------------------------------------------------------------

FINEST_CELL_DEG = 0.02
LEVELS = 16
#: Cells of areas that are broadcast: beyond them the salted shuffle repeats every cell.
MAX_CELLS = 1_500_000
MAX_CELL_BYTES = 192 * 1024 * 1024


def _cell(degrees: str, level: str) -> str:
    return f"cast(floor({degrees} / ({FINEST_CELL_DEG}D * shiftleft(1L, {level}))) AS BIGINT)"


def pair_areas(features: DataFrame, areas: DataFrame, key: str = "pos", broadcast: bool | None = None) -> DataFrame:
    """Pairs of features and areas whose lon/lat envelopes overlap.

    ``features`` has ``west, south, east, north`` and a unique ``key``. Both
    sides have a grid level that fits their size, where they cover at most four
    cells, and a pair meets on the coarser of its two levels: areas no coarser
    than the feature are listed on the feature's level too, and features are
    listed on the levels of coarser areas, so no joined row has the wrong
    level. The pair is kept in one cell: the one that holds the lower-left
    corner of the overlap.
    """
    joined = level_joins(features, areas, key, broadcast)
    return joined.filter(
        "west <= area_east AND east >= area_west AND south <= area_north AND north >= area_south "
        f"AND cx = {_cell('greatest(west, area_west)', 'level')} "
        f"AND cy = {_cell('greatest(south, area_south)', 'level')}"
    ).drop("level", "own_level", "cx", "cy", "area_west", "area_south", "area_east", "area_north")


def level_joins(features: DataFrame, areas: DataFrame, key: str = "pos", broadcast: bool | None = None) -> DataFrame:
    """Features and areas that share a cell of the coarser of their levels."""
    extent = "greatest(east - west, north - south)"
    level = f"least({LEVELS - 1}, greatest(0, cast(ceil(log2(greatest({extent}, 1e-12D) / {FINEST_CELL_DEG}D)) AS INT)))"

    def cells(df: DataFrame) -> DataFrame:
        columns = f"sequence({_cell('west', 'level')}, {_cell('east', 'level')})"
        rows = f"sequence({_cell('south', 'level')}, {_cell('north', 'level')})"
        return df.withColumn("cx", F.explode(F.expr(columns))).withColumn("cy", F.explode(F.expr(rows)))

    def boxes(df: DataFrame) -> DataFrame:
        return cells(df).select("level", "cx", "cy", "area_id", *[
            F.col(c).alias(f"area_{c}") for c in ("west", "south", "east", "north")])

    sized = areas.withColumn("area_level", F.expr(level))
    # At most LEVELS values, whatever the number of areas.
    used = sorted(r.area_level for r in sized.select("area_level").distinct().collect())
    coarser = f"filter(cast(array({', '.join(map(str, used))}) AS array<int>), l -> l > own_level)"
    placed = features.withColumn("own_level", F.expr(level))

    def meet(rows: DataFrame, listed: DataFrame) -> DataFrame:
        small = boxes(listed)
        held = fits_broadcast(small, MAX_CELLS, MAX_CELL_BYTES) if broadcast is None else broadcast
        return lookup(cells(rows), small, ["level", "cx", "cy"], "inner", spread_by=(key,), broadcast=held)

    finer_areas = meet(placed.withColumn("level", F.col("own_level")),
                       sized.withColumn("level", F.explode(F.expr(f"sequence(area_level, {LEVELS - 1})"))))
    coarser_areas = meet(placed.withColumn("level", F.explode(F.expr(coarser))),
                         sized.withColumn("level", F.col("area_level")))
    return finer_areas.unionByName(coarser_areas)
