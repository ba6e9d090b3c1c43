"""The whole job: areas, registries and features to spans, issues and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.operators import areas as area_ops
from lithogrid.operators import columns, evidence, export, local_geometry, numbering, raster, report, validity
from lithogrid.operators.local_geometry import MAX_EDGES_IN_ROW
from lithogrid.operators.lookup import lookup
from lithogrid.plans.workspace import Workspace
from lithogrid.sources import config as config_source
from lithogrid.sources import osm
from lithogrid.sources.geojson import parse_geometry

# The budget gate's message.
VOXELS_OVER_BUDGET = "Voxel budget exceeded; reduce area or increase voxel size"
NO_BUDGET = "max_voxels must be a number"
BUDGET_CHECK = 6
#: Areas of more columns are held against their budget before their spans are made.
WIDE = 1 << 16
#: Columns of a feature that are counted first, and how many times more in each further round.
FEW_COLUMNS, MORE = 1 << 10, 16

_AREAL = "geom_type IN ('Polygon', 'MultiPolygon')"
ATTRIBUTES = ["kind", "feature", "source", "y0", "y1"]


class GateError(ValueError):
    """A gate failed and nothing was published."""


@dataclass
class BuildResult:
    """Tables of one run; ``voxels`` and ``local_features`` are still plans."""

    areas: DataFrame
    registry: DataFrame
    features: DataFrame
    issues: DataFrame
    skipped: DataFrame
    violations: DataFrame
    spans: DataFrame
    voxel_counts: DataFrame
    work: Workspace

    @property
    def voxels(self) -> DataFrame:
        return raster.extrude(self.spans)

    @property
    def accepted(self) -> DataFrame:
        return self.features.filter("accepted")

    @property
    def local_features(self) -> DataFrame:
        """Clipped GeoJSON of the accepted features; large ones are projected whole here."""
        rows = self.accepted
        small = rows.filter(f"n_edges <= {MAX_EDGES_IN_ROW}")
        large = rows.filter(f"n_edges > {MAX_EDGES_IN_ROW}").drop("x", "z").withColumn(
            "usable", F.lit(True))
        whole = local_geometry.project_in_row(large, 2**31 - 1)
        both = small.unionByName(whole.select(*small.columns))
        return export.local_features(local_geometry.edges_in_row(both))

    @property
    def headers(self) -> DataFrame:
        return report.headers(self.areas, self.voxel_counts, self.accepted, self.issues, self.skipped)

    @property
    def list_pieces(self) -> DataFrame:
        return report.list_pieces(self.registry, self.issues, self.skipped)


def retain_evidence(inputs: dict[str, DataFrame], path: str) -> None:
    """Keep input rows as they were read; values that Parquet lacks become JSON text."""
    for name, rows in inputs.items():
        plain = [F.to_json(c).alias(c) if kind == "variant" else F.col(c) for c, kind in rows.dtypes]
        rows.select(plain).write.mode("overwrite").parquet(f"{path}/{name}")


def raise_first(violations: DataFrame) -> None:
    first = violations.orderBy("area_id", "stage", "pos", "code").limit(1).collect()
    if first:
        raise GateError(f"{first[0].message} (area {first[0].area_id})")


def prepare(features: DataFrame, framed: DataFrame, registry: DataFrame,
            max_edges: int = MAX_EDGES_IN_ROW, broadcast: bool | None = None) -> DataFrame:
    """Everything a feature's own row decides, in one narrow pass.

    Adds evidence, registration, the frame of its area, layers, the validity
    of small geometry, projected vertices and whether it is accepted. Large
    features keep ``rings`` for the jobs that spread their edges and are not
    accepted yet.
    """
    parsed = parse_geometry(features) if "geometry" in features.columns else features
    read = evidence.resolve_evidence(parsed)
    registered = evidence.with_registration(read, registry, broadcast=broadcast)
    outlined = local_geometry.with_outline(area_ops.attach_frame(registered, framed, broadcast=broadcast))
    judged = evidence.with_fatal_check(validity.check_in_row(outlined, max_edges))
    usable = judged.withColumn("usable", F.expr("fatal IS NULL AND error IS NULL"))
    projected = local_geometry.project_in_row(usable, max_edges)
    placed = raster.with_layers(local_geometry.touches_area(projected))
    return placed.select(
        "area_id", "pos", "id", "has_id", "properties", "geom_type", "malformed", "outline", "n_edges",
        F.expr(f"CASE WHEN n_edges > {max_edges} THEN rings END").alias("rings"),
        F.col("source_id").alias("source"), "kind", "registered", "thick", "width", "base", "height",
        "assumptions", "error", "fatal", "x", "z", F.col("in_area").alias("accepted"),
        F.expr("exists(x, v -> isnan(v))").alias("unreachable"),
        "y0", "y1", *area_ops.FRAME)


def small_spans(features: DataFrame, keep: list[str]) -> DataFrame:
    """Spans of small accepted features, without a shuffle."""
    edged = local_geometry.edges_in_row(features.filter("accepted"))
    areal = raster.polygon_spans(edged.filter(_AREAL), keep)
    thick = raster.thick_spans(edged.filter("thick"), keep)
    return areal.unionByName(thick)


def large_spans(features: DataFrame, keep: list[str]) -> DataFrame:
    """Spans of large accepted features; attributes are looked up afterwards."""
    rows = features.filter("accepted")
    areal = raster.large_polygon_spans(local_geometry.chunk_edges(rows.filter(_AREAL)))
    thick = raster.large_thick_spans(local_geometry.chunk_edges(rows.filter("thick")))
    attributes = rows.select("area_id", "pos", *[c for c in keep if c not in ("area_id", "pos")])
    return lookup(areal.unionByName(thick), attributes, ["area_id", "pos"], "inner", spread_by=("x",))


def _counted(features: DataFrame, wanted: int) -> DataFrame:
    """(area_id, voxels, exact, pos): voxels of each feature in some of its columns, evenly spaced."""
    keep = ["area_id", "pos", "y0", "y1"]
    layers = (F.col("y1") - F.col("y0")).cast("double")
    edged = local_geometry.edges_in_row(features.filter(f"n_edges <= {MAX_EDGES_IN_ROW}"))
    counted = columns.counted(edged.filter(_AREAL), keep, False, wanted).unionByName(
        columns.counted(edged.filter("thick"), keep, True, wanted))
    large = features.filter(f"n_edges > {MAX_EDGES_IN_ROW}").withColumn(
        "stride", F.expr(f"cast(last_column - first_column AS bigint) div {wanted} + 1"))
    spans = raster.large_polygon_spans(local_geometry.chunk_edges(large.filter(_AREAL))).unionByName(
        raster.large_thick_spans(local_geometry.chunk_edges(large.filter("thick"))))
    cells = spans.groupBy("area_id", "pos").agg(F.sum((F.col("z1") - F.col("z0") + 1).cast("double")).alias("cells"))
    wide = large.select(*keep, (F.col("stride") == 1).alias("exact")).join(cells, ["area_id", "pos"], "left").fillna(
        {"cells": 0.0}).select(*counted.columns)
    return counted.unionByName(wide).select("area_id", "pos", (F.col("cells") * layers).alias("voxels"), "exact")


def wide_violations(features: DataFrame, framed: DataFrame, work: Workspace) -> DataFrame | None:
    """Areas of very many columns that are over budget, before any span of them exists.

    A feature's voxels over some of its columns bound its voxels from below. Few
    columns are counted first; only features of areas that the bound leaves
    undecided are counted again over more columns, until it decides or all of
    their columns are counted. None where no area is that wide.
    """
    undecided = framed.filter(f"last_column - first_column >= {WIDE}").select("area_id", "max_voxels")
    if undecided.isEmpty():
        return None
    left = features.filter("accepted").join(F.broadcast(undecided.select("area_id")), "area_id", "left_semi")
    known, wanted, found = None, FEW_COLUMNS, []
    while True:
        counted = work.save(_counted(left, wanted), f"counted-{wanted}")
        every = counted if known is None else counted.unionByName(known)
        bounds = every.groupBy("area_id").agg(F.sum("voxels").alias("voxel_records"))
        over = work.save(budget_violations(undecided, bounds), f"over-{wanted}")
        found.append(over)
        gone = over.select("area_id")
        undecided = undecided.join(gone, "area_id", "left_anti")
        more = counted.filter("NOT exact").join(gone, "area_id", "left_anti").select("area_id", "pos")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, found)
        known = every.filter("exact")
        left = left.join(more, ["area_id", "pos"], "left_semi")
        wanted *= MORE


def _with_large(prepared: DataFrame, work: Workspace) -> DataFrame:
    """Fill in validity and contact of large features, if there are any."""
    small = prepared.filter(f"n_edges <= {MAX_EDGES_IN_ROW}")
    large = prepared.filter(f"n_edges > {MAX_EDGES_IN_ROW}")
    if large.isEmpty():
        return small
    sound = large.filter("NOT malformed AND error IS NULL")
    errors = work.save(validity.check_large(sound.filter(_AREAL), work.save), "large-errors")
    contact = work.save(local_geometry.large_contact(local_geometry.chunk_edges(sound)), "large-contact")
    known = (
        large.withColumnRenamed("error", "_early").drop("fatal", "accepted", "unreachable")
        .join(errors, ["area_id", "pos"], "left").join(contact, ["area_id", "pos"], "left")
        .withColumn("error", F.coalesce("_early", "error"))
        .fillna({"in_area": False, "unreachable": False})
    )
    judged = evidence.with_fatal_check(known).withColumn(
        "accepted", F.expr("fatal IS NULL AND error IS NULL AND in_area"))
    return small.unionByName(judged.select(*small.columns))


def _with_names(checked: DataFrame, work: Workspace) -> DataFrame:
    """Add ``feature``: the id, or the running count where there is none."""
    named = checked.filter("has_id").withColumn("feature", F.col("id"))
    nameless = checked.filter("NOT has_id")
    if nameless.isEmpty():
        return named
    counted = numbering.with_accepted_before(checked.select("area_id", "pos", "has_id", "accepted"))
    numbers = work.save(counted.filter("NOT has_id").select(
        "area_id", "pos", F.col("accepted_before").cast("string").alias("feature")), "default-ids")
    return named.unionByName(nameless.join(numbers, ["area_id", "pos"]))


def build(
    areas: DataFrame,
    sources: DataFrame,
    features: DataFrame,
    skipped: DataFrame | None = None,
    violations: DataFrame | None = None,
    on_violation: str = "raise",
    evidence_path: str | None = None,
) -> BuildResult:
    """Run all gates and derive everything short of the voxel rows.

    Features without a column ``area_id`` belong to every area that their
    envelope overlaps.
    The first violation (by area, stage, position) raises :class:`GateError`;
    the voxel budget of areas of very many columns is judged before that of the others.
    With ``on_violation="skip"`` the areas concerned are left out instead and
    listed in the result's ``violations``; the other areas go on. The inputs are
    kept under ``evidence_path``, before any gate, so that they outlive a failed run.
    """
    spark = areas.sparkSession
    work = Workspace(spark)
    if evidence_path:
        retain_evidence({"areas": areas, "sources": sources, "features": features}, evidence_path)
    skip = on_violation == "skip"

    framed = work.save(area_ops.frame_areas(areas), "areas")
    registry = work.save(config_source.registry(sources), "registry")
    if "area_id" not in features.columns:
        features = with_areas(features, framed)
    found = area_ops.input_violations(framed, features, registry).unionByName(
        area_ops.area_violations(framed)).unionByName(area_ops.source_violations(registry))
    if violations is not None:
        found = found.unionByName(violations)
    found = work.save(found, "area-violations")
    if not skip:
        raise_first(found)
    usable = framed.join(found.select("area_id").distinct(), "area_id", "left_anti")

    prepared = work.save(prepare(features, usable, registry), "prepared")
    checked = evidence.with_reach_check(_with_large(prepared, work))
    broken = work.save(evidence.feature_violations(checked).unionByName(
        evidence.repeated_positions(prepared)), "feature-violations")
    if not skip:
        raise_first(broken)
    failed = broken.select("area_id").distinct()
    named = _with_names(checked.join(failed, "area_id", "left_anti") if skip else checked, work)

    early = wide_violations(named, usable, work)
    if early is not None:
        if not skip:
            raise_first(early)
        found = found.unionByName(early)
        usable, named = (df.join(early.select("area_id"), "area_id", "left_anti") for df in (usable, named))

    keep = ["area_id", "pos", *ATTRIBUTES]
    small = small_spans(named.filter(f"n_edges <= {MAX_EDGES_IN_ROW}"), keep)
    large_rows = named.filter(f"n_edges > {MAX_EDGES_IN_ROW}")
    if not large_rows.isEmpty():
        small = small.unionByName(large_spans(large_rows, keep))
    spans = work.save(small, "spans")

    counts = work.save(voxel_counts(spans), "voxel-counts")
    over = work.save(budget_violations(usable, counts), "budget-violations")
    if not skip:
        raise_first(over)
    all_failed = found.unionByName(broken).unionByName(over)
    if skip:
        gone = all_failed.select("area_id").distinct()
        usable, named, spans, counts = (
            df.join(gone, "area_id", "left_anti") for df in (usable, named, spans, counts))
    no_skips = spark.createDataFrame([], "area_id STRING, pos BIGINT, id BIGINT, reason STRING")
    return BuildResult(
        areas=usable,
        registry=registry.join(usable.select("area_id"), "area_id", "left_semi"),
        features=named,
        issues=evidence.issues_of(named.drop("id").withColumnRenamed("feature", "id")),
        skipped=no_skips if skipped is None else skipped.join(usable.select("area_id"), "area_id", "left_semi"),
        violations=all_failed,
        spans=spans,
        voxel_counts=counts,
        work=work,
    )


def with_areas(features: DataFrame, framed: DataFrame) -> DataFrame:
    """Features of one collection, once for each area whose box their envelope overlaps.

    Features without an envelope (empty or unreadable geometry) lie nowhere;
    they are reported once, in the area with the smallest id.
    """
    parsed = parse_geometry(features)

    def bound(kind: str, axis: str):
        return F.expr(f"array_{kind}(flatten(transform(rings, g -> g.{axis})))")

    boxed = parsed.select(
        "*", bound("min", "lon").alias("west"), bound("min", "lat").alias("south"),
        bound("max", "lon").alias("east"), bound("max", "lat").alias("north"))
    boxes = framed.filter(area_ops.bbox_is_valid()).select("area_id", "west", "south", "east", "north")
    nowhere = F.col("malformed") | F.col("west").isNull() | F.col("south").isNull()
    paired = area_ops.pair_areas(boxed.filter(~nowhere), boxes).select("area_id", *parsed.columns)
    first = framed.agg(F.min("area_id")).first()[0]
    return paired.unionByName(boxed.filter(nowhere).select(F.lit(first).alias("area_id"), *parsed.columns))


def voxel_counts(spans: DataFrame) -> DataFrame:
    """Voxels per area, counted from the spans before any voxel row exists."""
    return spans.groupBy("area_id").agg(F.sum(raster.span_voxels(spans)).alias("voxel_records"))


def budget_violations(framed: DataFrame, counts: DataFrame) -> DataFrame:
    """Areas over their voxel budget, and those whose budget is no number."""
    known = framed.join(counts, "area_id", "left")
    within = F.coalesce(F.coalesce("voxel_records", F.lit(0)) <= F.col("max_voxels"), F.lit(False))
    return known.filter(~within).select(
        "area_id", F.lit(BUDGET_CHECK).alias("stage"), F.lit(-1).cast("bigint").alias("pos"),
        F.lit(0).alias("code"),
        F.when(F.col("max_voxels").isNull(), NO_BUDGET).otherwise(VOXELS_OVER_BUDGET).alias("message"))


def build_from_osm(areas: DataFrame, sources: DataFrame, extracts: DataFrame, elements: DataFrame | None = None,
                   evidence_path: str | None = None, **options) -> BuildResult:
    """Like :func:`build`, with features classified from OpenStreetMap extracts.

    ``elements`` are given apart where many tasks read each extract; ``extracts``
    then has the remarks. Both are kept under ``evidence_path`` as they were
    read, before any gate, beside the features derived from them.
    """
    if evidence_path:
        retain_evidence({"extracts": extracts, **({} if elements is None else {"elements": elements})}, evidence_path)
    boxes = areas.select("area_id", "west", "south", "east", "north")
    placed = lookup(osm.elements_of(extracts) if elements is None else elements, boxes, ["area_id"], "inner")
    classified = osm.classify(osm.select_elements(placed))
    return build(
        areas,
        config_source.with_osm_source(sources, areas),
        osm.osm_features(classified),
        skipped=osm.skipped_elements(classified),
        violations=osm.incomplete_extracts(extracts).unionByName(area_ops.input_violations(areas, extracts)),
        evidence_path=evidence_path,
        **options,
    )
