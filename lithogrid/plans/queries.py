"""Queries over the benchmark's star-schema tables, one per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.functions import planar
from lithogrid.operators import areas as area_ops
from lithogrid.operators import evidence, export, local_geometry, numbering, raster, report, validity
from lithogrid.operators.lookup import lookup
from lithogrid.plans import derived
from lithogrid.plans.build import budget_violations, large_spans, prepare, small_spans, voxel_counts
from lithogrid.plans.workspace import Workspace
from lithogrid.sources import config, geojson, osm
from lithogrid.sources.split_json import read_array


def _tidy(metres: Column) -> Column:
    """Four decimals without a negative zero."""
    short = F.round(metres, 4)
    return F.when(short == 0, 0.0).otherwise(short)


def _prepared(spark: SparkSession, sf_dir: str, features: DataFrame) -> DataFrame:
    framed = area_ops.frame_areas(derived.areas(spark, sf_dir))
    registry = config.registry(derived.sources(spark, sf_dir))
    return prepare(features, framed, registry).withColumn("feature", F.col("id"))


def _stored(spark: SparkSession, sf_dir: str, features: DataFrame) -> DataFrame:
    """The prepared table as a stage of its own, as in a whole run: several readers follow."""
    return Workspace(spark).save(_prepared(spark, sf_dir, features), "prepared")


_KEEP = ["area_id", "pos", "kind", "feature", "source", "y0", "y1"]


def _footprint_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir, derived.footprints(spark, sf_dir))
    return raster.polygon_spans(local_geometry.edges_in_row(rows.filter("accepted")), _KEEP)


def _line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir, derived.lines(spark, sf_dir))
    return raster.thick_spans(local_geometry.edges_in_row(rows.filter("accepted")), _KEEP)


def _per_feature(spans: DataFrame) -> DataFrame:
    cells = F.col("z1") - F.col("z0") + 1
    return spans.groupBy("area_id", "pos").agg(
        F.sum(cells).alias("cells"),
        F.sum(cells * (F.col("y1") - F.col("y0"))).alias("voxels"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("z0").alias("min_z"), F.max("z1").alias("max_z"))


# --- generation ---------------------------------------------------------------------------------

def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.extrude(_footprint_spans(spark, sf_dir))


def footprint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_feature(_footprint_spans(spark, sf_dir))


def capsule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_feature(_line_spans(spark, sf_dir))


def voxel_counts_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _footprint_spans(spark, sf_dir).unionByName(_line_spans(spark, sf_dir))
    return spans.groupBy("area_id", "kind").agg(
        F.sum(raster.span_voxels(spans)).cast("bigint").alias("voxel_records"))


def voxel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = derived.areas(spark, sf_dir).withColumn(
        "max_voxels", F.expr("CASE WHEN nation % 10 <> 4 THEN cast(500 * (nation % 10) AS BIGINT) END"))
    counts = voxel_counts(_footprint_spans(spark, sf_dir))
    return budget_violations(areas, counts).select("area_id", "stage", "message")


def _star_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = area_ops.frame_areas(derived.star_areas(spark, sf_dir))
    registry = config.registry(derived.star_sources(spark, sf_dir))
    return prepare(derived.stars(spark, sf_dir), framed, registry)


def large_polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _star_prepared(spark, sf_dir).withColumn("accepted", F.lit(True)).withColumn("feature", F.col("id"))
    return _per_feature(large_spans(rows, _KEEP))


# --- geometry -----------------------------------------------------------------------------------

def project_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = area_ops.frame_areas(derived.areas(spark, sf_dir))
    rows = area_ops.attach_frame(derived.footprints(spark, sf_dir), framed)
    outlined = local_geometry.with_outline(rows).withColumn("usable", F.lit(True))
    local = local_geometry.project_in_row(outlined)
    return local.select(
        "pos", F.posexplode(F.arrays_zip("x", "z")).alias("i", "v")).select(
        "pos", "i", _tidy(F.col("v.x")).alias("x"), _tidy(F.col("v.z")).alias("z"))


def area_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = area_ops.frame_areas(derived.part_areas(spark, sf_dir))
    corners = [_tidy(F.get(axis, F.lit(i))).alias(f"{name}{i}")
               for axis, name in (("qx", "x"), ("qz", "z")) for i in range(4)]
    return framed.select("area_id", *corners, F.round("area_m2", 2).alias("area_m2"))


def area_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = area_ops.frame_areas(derived.part_areas(spark, sf_dir))
    return area_ops.area_violations(framed).select("area_id", "stage", "message")


def input_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas configured twice, and areas of sources and features that are not configured."""
    found = area_ops.input_violations(
        derived.configured(spark, sf_dir), derived.supplier_sources(spark, sf_dir), derived.citations(spark, sf_dir))
    return found.select("area_id", "stage", "code", "message")


def pair_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_ops.pair_areas(
        derived.order_boxes(spark, sf_dir), derived.supplier_boxes(spark, sf_dir)).select("pos", "area_id")


def line_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir, derived.lines(spark, sf_dir)).filter("geom_type = 'LineString'")
    segments = local_geometry.edges_in_row(rows).select(
        "pos", F.posexplode_outer(F.expr(f"transform(edges, e -> {planar.CLIPPED_SEGMENT})")).alias("i", "s"))
    return segments.filter("s IS NOT NULL").select(
        "pos", "i", _tidy(F.col("s.px")).alias("west"), _tidy(F.col("s.px") + F.col("s.dx")).alias("east"),
        _tidy(F.least("s.pz", F.col("s.pz") + F.col("s.dz"))).alias("south"),
        _tidy(F.greatest("s.pz", F.col("s.pz") + F.col("s.dz"))).alias("north"))


def in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prepared(spark, sf_dir, derived.footprints(spark, sf_dir))
    return rows.groupBy("area_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("dropped"))


def validity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = derived.shapes(spark, sf_dir)
    judged = validity.check_in_row(local_geometry.with_outline(shapes), local_geometry.MAX_EDGES_IN_ROW)
    return judged.select("pos", F.regexp_extract(F.coalesce("error", F.lit("")), r"^[^\[]*", 0).alias("reason"))


def validity_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = local_geometry.with_outline(derived.stars(spark, sf_dir))
    errors = validity.check_large(stars, Workspace(spark).save)
    return stars.select("area_id", "pos").join(errors, ["area_id", "pos"], "left").select(
        "pos", F.regexp_extract(F.coalesce("error", F.lit("")), r"^[^\[]*", 0).alias("reason"))


# --- evidence -----------------------------------------------------------------------------------

def resolve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = evidence.resolve_evidence(derived.evidence_rows(spark, sf_dir))
    return read.select(
        "pos", "kind",
        F.coalesce("width", F.lit(-1.0)).alias("width"), F.coalesce("base", F.lit(-999.0)).alias("base"),
        "height", F.array_join("assumptions", "|").alias("assumptions"),
        evidence.bad_width().alias("bad_width"), evidence.bad_elevation().alias("bad_elevation"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir, derived.patchy_footprints(spark, sf_dir))
    return evidence.issues_of(rows).select(
        "area_id", "pos", "feature", "severity", F.array_join("reasons", "|").alias("reasons"))


def registry_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.registry(derived.supplier_sources(spark, sf_dir)).select(
        "area_id", "id", "pos", "url", "license", "complete")


def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = area_ops.source_violations(config.registry(derived.supplier_sources(spark, sf_dir)))
    return found.groupBy("area_id", "message").agg(F.count(F.lit(1)).alias("sources"))


def unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = config.registry(derived.supplier_sources(spark, sf_dir))
    cited = derived.citations(spark, sf_dir)
    return evidence.with_registration(cited, known).filter("NOT registered").select("area_id", "pos", "source_id")


def default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = numbering.with_accepted_before(derived.nameless(spark, sf_dir), block_bits=8)
    return counted.select("area_id", "pos", numbering.default_id(
        F.col("has_id"), F.col("id"), F.col("accepted_before")).alias("feature"))


# --- OpenStreetMap ------------------------------------------------------------------------------

def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.classify(derived.elements(spark, sf_dir))


def classify_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("area_id", "pos", "kind")


def skipped_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm.skipped_elements(_classified(spark, sf_dir)).select("area_id", "pos", "id", "reason")


def osm_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = osm.osm_features(_classified(spark, sf_dir))
    return made.select(
        "area_id", "pos", "id", "geom_type",
        F.try_variant_get("properties", "$.kind", "string").alias("kind"),
        F.try_variant_get("properties", "$.source_id", "string").alias("source_id"),
        F.try_variant_get("properties", "$.building", "string").alias("building"),
        F.expr("size(rings[0].lon)").alias("vertices"))


def select_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = derived.areas(spark, sf_dir).select("area_id", "west", "south", "east", "north")
    elements = lookup(derived.elements(spark, sf_dir), boxes, ["area_id"], "inner")
    return osm.select_elements(elements).groupBy("area_id", "type").agg(F.count(F.lit(1)).alias("elements"))


# --- documents ---------------------------------------------------------------------------------

def split_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of collections, one document per area, that many tasks read each."""
    work = Workspace(spark)
    derived.write_documents(spark, sf_dir, f"{work.path}/documents")
    members, _ = read_array(spark, f"{work.path}/documents/*", "features", work.save)
    area = F.regexp_extract("file", "area_id=([^/]*)", 1)
    rows = geojson.parse_geometry(geojson.features_of(members.withColumn("area_id", area)))
    return rows.select(
        "area_id", "pos", "id", F.try_variant_get("properties", "$.kind", "string").alias("kind"),
        F.expr("aggregate(rings, 0L, (n, g) -> n + size(g.lon))").alias("vertices"),
        F.round(F.expr("rings[0].lon[0]"), 6).alias("west"), F.round(F.expr("rings[0].lat[0]"), 6).alias("south"))


# --- outputs ------------------------------------------------------------------------------------

def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = area_ops.frame_areas(derived.areas(spark, sf_dir))
    rows = _stored(spark, sf_dir, derived.patchy_footprints(spark, sf_dir))
    counts = voxel_counts(small_spans(rows, _KEEP))
    skipped = osm.skipped_elements(_classified(spark, sf_dir))
    headers = report.headers(framed, counts, rows.filter("accepted"), evidence.issues_of(rows), skipped)
    return headers.select(
        "area_id", "voxel_size_m", "voxel_records", "features", "errors", "warnings", "skipped_osm",
        "strict_failed")


def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of each area's report: version, local system, axes and limitations."""
    framed = area_ops.frame_areas(derived.areas(spark, sf_dir))
    rows = derived.footprints(spark, sf_dir)
    skipped = osm.skipped_elements(_classified(spark, sf_dir))
    counts = rows.groupBy("area_id").agg(F.sum("pos").alias("voxel_records"))
    errors = rows.filter("pos % 7 = 0").select("area_id", F.lit("error").alias("severity"))
    found = report.headers(framed, counts, rows, errors, skipped)
    number = lambda key: F.round(F.regexp_extract("crs", rf"\+{key}=([-+.0-9Ee]+)", 1).cast("double"), 9)
    return found.select(
        "area_id", "version", number("lat_0").alias("lat_0"), number("lon_0").alias("lon_0"),
        F.regexp_replace("crs", r"=[-+.0-9][-+.0-9Ee]*", "=").alias("crs"), F.concat_ws(",", "axis.x", "axis.y", "axis.z").alias("axis"),
        F.array_join("limitations", "|").alias("limitations"), "voxel_records", "features", "errors", "skipped_osm", "strict_failed")


def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir, derived.patchy_footprints(spark, sf_dir))
    skipped = osm.skipped_elements(_classified(spark, sf_dir))
    registry = config.registry(derived.supplier_sources(spark, sf_dir))
    pieces = report.list_pieces(registry, evidence.issues_of(rows), skipped)
    return pieces.select("area_id", "list", "piece", F.size("entries").alias("entries"))


def export_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of the exported GeoJSON text."""
    rows = _prepared(spark, sf_dir, derived.footprints(spark, sf_dir)).filter("accepted")
    # the text is stored first: generators over a computed text would clip once for each use of it
    written = Workspace(spark).save(export.local_features(local_geometry.edges_in_row(rows)), "exported")
    shape = "id STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    read = written.select("area_id", "pos", F.from_json("feature_json", shape).alias("f"))
    vertices = read.select("area_id", "pos", F.col("f.id").alias("feature"), F.inline_outer(F.flatten(F.transform(
        "f.geometry.coordinates", lambda ring, k: F.transform(ring, lambda v, i: F.struct(
            k.alias("ring"), i.alias("i"), v[0].alias("vx"), v[1].alias("vz")))))))
    return vertices.filter("ring IS NOT NULL").select(
        "area_id", "pos", "feature", "ring", "i", _tidy(F.col("vx")).alias("x"), _tidy(F.col("vz")).alias("z"))


QUERIES = {
    "voxels": voxels,
    "footprint_cells": footprint_cells,
    "capsule_cells": capsule_cells,
    "voxel_counts": voxel_counts_by_area,
    "voxel_budget": voxel_budget,
    "large_polygon_cells": large_polygon_cells,
    "project_vertices": project_vertices,
    "area_quad": area_quad,
    "area_gates": area_gates,
    "input_gates": input_gates,
    "pair_areas": pair_areas,
    "line_clip": line_clip,
    "in_area": in_area,
    "validity": validity_reasons,
    "validity_large": validity_large,
    "resolve_evidence": resolve_evidence,
    "issues": issues,
    "registry_last_wins": registry_last_wins,
    "source_gate": source_gate,
    "unregistered": unregistered,
    "default_ids": default_ids,
    "classify_kinds": classify_kinds,
    "skipped_elements": skipped_elements,
    "osm_geometry": osm_geometry,
    "select_elements": select_elements,
    "split_collections": split_collections,
    "quality_report": quality_report,
    "report_header": report_header,
    "report_lists": report_lists,
    "export_features": export_features,
}
