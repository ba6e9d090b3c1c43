"""Whole runs on small hand-made maps."""

import copy
import json
import os

import pytest
from pyspark.sql import functions as F

from lithogrid import GateError, build, build_from_osm, publish
from lithogrid.sources import config, geojson, osm

PLAN = {"id": "plan", "url": "https://plans.test/city", "license": "CC-BY-4.0"}
CONFIG = {"bbox": [0, 0, 0.001, 0.001], "sources": [PLAN]}
# The coordinates and heights of the acceptance case.
TOWER = {
    "type": "Feature", "id": "tower",
    "properties": {"source_id": "plan", "kind": "building", "height_m": 3, "base_elevation_m": 10},
    "geometry": {"type": "Polygon", "coordinates": [
        [[0.0004, 0.0004], [0.0006, 0.0004], [0.0006, 0.0006], [0.0004, 0.0006], [0.0004, 0.0004]]]},
}


def square(west, south, east, north):
    return [[west, south], [east, south], [east, north], [west, north], [west, south]]


def feature(geom_type, coordinates, **properties):
    return {"geometry": {"type": geom_type, "coordinates": coordinates},
            "properties": {"source_id": "plan", "height_m": 1, "base_elevation_m": 0, **properties}}


def run(spark, folder, features, configuration=CONFIG, **options):
    os.makedirs(folder / "features", exist_ok=True)
    (folder / "area.json").write_text(json.dumps(configuration))
    (folder / "features" / "area.json").write_text(json.dumps({"features": features}))
    configs = config.read_configs(spark, str(folder / "area.json"))
    return build(config.areas_of(configs), config.sources_of(configs),
                 geojson.read_collections(spark, str(folder / "features")), **options)


def test_tower_fills_its_layers(spark, tmp_path):
    result = run(spark, tmp_path, [TOWER])
    rows = result.voxels.collect()
    assert len(rows) == 1452
    assert {r.y for r in rows} == {10, 11, 12}
    assert (min(r.x for r in rows), max(r.x for r in rows)) == (-11, 10)
    assert {(r.kind, r.feature, r.source) for r in rows} == {("building", "tower", "plan")}
    assert result.issues.count() == 0


def test_missing_evidence_is_an_issue(spark, tmp_path):
    bare = copy.deepcopy(TOWER)
    del bare["properties"]["height_m"]
    result = run(spark, tmp_path, [bare])
    issue = result.issues.collect()[0]
    assert (issue.severity, issue.reasons) == ("warning", ["height assumed 1 m; actual vertical geometry unknown"])
    assert {r.y for r in result.voxels.select("y").distinct().collect()} == {10}


def test_budget_fails_before_any_voxel(spark, tmp_path):
    with pytest.raises(GateError, match="Voxel budget"):
        run(spark, tmp_path, [TOWER], {**CONFIG, "max_voxels": 1})


COMB = {**TOWER, "id": "comb", "geometry": {"type": "Polygon", "coordinates": [[
    [0.0001, 0.0001], *([x / 1e6, z] for k in range(200, 900, 10) for x, z in ((k, 0.0001), (k + 2, 0.0009), (k + 4, 0.0001))),
    [0.0009, 0.00005], [0.0001, 0.00005], [0.0001, 0.0001]]]}}
PATH = {**TOWER, "id": "path", "properties": {"source_id": "plan", "kind": "road", "height_m": 1, "base_elevation_m": 0},
        "geometry": {"type": "LineString", "coordinates": [[0.0001, 0.0001], [0.0009, 0.0008]]}}


@pytest.mark.parametrize("given", [TOWER, COMB], ids=["small", "large"])
def test_budget_of_tiny_voxels_fails_before_any_span(spark, tmp_path, monkeypatch, given):
    from lithogrid.plans import build as plan

    monkeypatch.setattr(plan, "small_spans", None)
    monkeypatch.setattr(plan, "large_spans", None)
    with pytest.raises(GateError, match="Voxel budget"):
        run(spark, tmp_path, [given], {**CONFIG, "voxel_size_m": 1e-6})


def test_bounds_over_some_columns_end_at_the_exact_count(spark, tmp_path, monkeypatch):
    from lithogrid.operators import raster
    from lithogrid.plans import build as plan

    monkeypatch.setattr(raster, "COLUMN_BLOCK", 7)
    result = run(spark, tmp_path, [TOWER, COMB, PATH])
    exact = {r.pos: r.voxels for r in result.spans.groupBy("pos").agg(
        F.sum(raster.span_voxels(result.spans)).alias("voxels")).collect()}
    accepted = plan.Workspace(spark).save(result.accepted, "accepted")
    few, every = ({r.pos: r for r in plan._counted(accepted, wanted).collect()} for wanted in (20, 1000))
    assert {k: r.voxels for k, r in every.items()} == exact and all(r.exact for r in every.values())
    assert all(0 < r.voxels < exact[k] and not r.exact for k, r in few.items()) and len(few) == 3

    monkeypatch.setattr(plan, "WIDE", 10)
    monkeypatch.setattr(plan, "FEW_COLUMNS", 20)
    total = sum(exact.values())
    for budget, want in ((total, []), (total - 1, [plan.VOXELS_OVER_BUDGET])):
        areas = result.areas.withColumn("max_voxels", F.lit(budget))
        over = plan.wide_violations(accepted, areas, plan.Workspace(spark))
        assert [r.message for r in over.collect()] == want
    monkeypatch.setattr(plan, "WIDE", 1 << 16)
    assert plan.wide_violations(accepted, result.areas, result.work) is None


def test_unknown_source_fails(spark, tmp_path):
    with pytest.raises(GateError, match="tower has no registered source"):
        run(spark, tmp_path, [TOWER], {**CONFIG, "sources": []})


@pytest.mark.parametrize("change, message", [
    ({"bbox": [0.001, 0, 0, 0.001]}, "bbox must be"),
    ({"bbox": [0, 0, 0.001, 90]}, "bbox must be"),
    ({"voxel_size_m": 0}, "voxel_size_m"),
    ({"max_area_m2": 100}, "Area exceeds"),
    ({"sources": [{"id": "plan", "url": "u"}]}, "url and license"),
])
def test_area_gates(spark, tmp_path, change, message):
    with pytest.raises(GateError, match=message):
        run(spark, tmp_path, [TOWER], {**CONFIG, **change})


def test_last_source_entry_wins(spark, tmp_path):
    result = run(spark, tmp_path, [TOWER], {**CONFIG, "sources": [{"id": "plan"}, PLAN]})
    assert [r.license for r in result.registry.collect()] == ["CC-BY-4.0"]


def test_mixed_collection(spark, tmp_path):
    """Ids, errors, drops, holes, clipping, lines and points in one run."""
    features = [
        feature("Polygon", [square(0.0004, 0.0004, 0.0006, 0.0006), square(0.00045, 0.00045, 0.00055, 0.00055)]),
        feature("Polygon", [[[0, 0], [0.0001, 0.0001], [0.0001, 0], [0, 0.0001], [0, 0]]]),
        feature("Polygon", [square(0.002, 0.002, 0.003, 0.003)], height_m="abc"),
        feature("LineString", [[0.0002, 0.0005], [0.0003, 0.0005]], width_m=2),
        feature("Point", [0.0001, 0.0001], width_m="4"),
        feature("Polygon", [square(-0.001, -0.001, 0.002, 0.002)], kind="water"),
        {**feature("Polygon", []), "id": None},
        feature("MultiPoint", [[0.0001, 0.0001]]),
    ]
    result = run(spark, tmp_path, features)
    accepted = {r.pos: r.feature for r in result.accepted.collect()}
    assert accepted == {0: "0", 3: "1", 4: "2", 5: "3", 7: "4"}
    issues = {r.pos: (r.severity, r.reasons) for r in result.issues.collect()}
    assert issues[1][0] == "error" and issues[1][1][0].startswith("Self-intersection[")
    assert issues[2] == ("warning", ["unparseable height; assumed 1 m"])
    assert issues[6] == ("error", ["Empty geometry"])
    assert set(issues) == {1, 2, 6}
    cells = {r.feature: r["count"] for r in result.voxels.groupBy("feature").count().collect()}
    assert set(cells) == {"0", "1", "2", "3"}
    assert cells["0"] == 22 * 22 - 12 * 12
    assert cells["1"] in range(20, 30)
    assert cells["2"] in range(9, 16)
    # The area itself is 111.3 m by 110.6 m.
    assert cells["3"] == 112 * 110 or cells["3"] == 110 * 110


def test_only_thickened_after_clip(spark, tmp_path):
    """A line that leaves and re-enters the area is thickened on both pieces."""
    zigzag = feature("LineString", [[0.0005, 0.0005], [0.0015, 0.0005], [0.0015, 0.0008], [0.0005, 0.0008]], width_m=2)
    result = run(spark, tmp_path, [zigzag])
    rows = result.voxels.collect()
    assert max(r.x for r in rows) <= 55
    assert len({r.z for r in rows}) == 4


@pytest.mark.parametrize("properties, message", [
    ({"width_m": 0}, "Invalid width"),
    ({"width_m": "wide"}, "Invalid width"),
    ({"base_elevation_m": None}, "Invalid elevation or height"),
    ({"height_m": 0}, "Invalid elevation or height"),
    ({"height_m": "inf"}, "Invalid elevation or height"),
])
def test_fatal_properties(spark, tmp_path, properties, message):
    with pytest.raises(GateError, match=message):
        run(spark, tmp_path, [feature("LineString", [[0.0001, 0.0001], [0.0002, 0.0002]], **properties)])


def test_invalid_geometry_shadows_a_bad_height(spark, tmp_path):
    bow = feature("Polygon", [[[0, 0], [0.0001, 0.0001], [0.0001, 0], [0, 0.0001], [0, 0]]], height_m=0)
    assert run(spark, tmp_path, [bow]).issues.collect()[0].severity == "error"
    with pytest.raises(GateError, match="no registered source"):
        run(spark, tmp_path, [{**bow, "properties": {"source_id": "other"}}])


def test_first_violation_by_position(spark, tmp_path):
    good, bad = feature("Point", [0.0001, 0.0001], width_m=1), feature("Point", [0.0001, 0.0001], width_m=-1)
    with pytest.raises(GateError, match="Invalid width on #1"):
        run(spark, tmp_path, [good, bad, {**bad, "properties": {"source_id": "none"}}])


def test_publish_and_strict_gate(spark, tmp_path):
    result = run(spark, tmp_path, [TOWER], {**CONFIG, "strict": True})
    out = str(tmp_path / "out")
    summary = publish(result, out, rows_per_file=400)
    assert summary["voxel_records"] == 1452
    written = spark.read.parquet(f"{out}/voxels")
    assert written.count() == 1452 and len(written.inputFiles()) > 1
    header = spark.read.json(f"{out}/quality-report").first()
    assert (header.voxel_records, header.features, header.strict_failed) == (1452, 1, False)
    assert spark.read.json(f"{out}/checksums").filter("length(sha256) = 64").count() == len(written.inputFiles())
    line = json.loads(spark.read.text(f"{out}/features-local").first().value)
    assert line["id"] == "tower" and len(line["geometry"]["coordinates"][0]) == 5
    other = run(spark, tmp_path, [TOWER], {**CONFIG, "strict": True})
    assert publish(other, str(tmp_path / "again"), voxel_format="json")["digest"] == summary["digest"]


def test_strict_gate_fails_after_writing(spark, tmp_path):
    bare = copy.deepcopy(TOWER)
    del bare["properties"]["base_elevation_m"]
    result = run(spark, tmp_path, [bare], {**CONFIG, "strict": True})
    with pytest.raises(GateError, match="Strict"):
        publish(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "voxels")).count() == 1452
    pieces = spark.read.json(str(tmp_path / "out" / "report-lists")).collect()
    assert {p.list for p in pieces} == {"sources", "issues"}


def test_failing_area_is_left_out_on_request(spark, tmp_path):
    os.makedirs(tmp_path / "configs")
    os.makedirs(tmp_path / "features")
    for name, change in (("good", {}), ("small", {"max_voxels": 1}), ("bad", {"voxel_size_m": -1})):
        (tmp_path / "configs" / f"{name}.json").write_text(json.dumps({**CONFIG, **change}))
        (tmp_path / "features" / f"{name}.json").write_text(json.dumps({"features": [TOWER]}))
    configs = config.read_configs(spark, str(tmp_path / "configs"))
    result = build(config.areas_of(configs), config.sources_of(configs),
                   geojson.read_collections(spark, str(tmp_path / "features")), on_violation="skip")
    assert {r.area_id for r in result.voxels.select("area_id").distinct().collect()} == {"good"}
    assert {r.area_id for r in result.violations.collect()} == {"small", "bad"}
    assert result.headers.count() == 1


def test_collections_and_far_vertices(spark, tmp_path):
    """A collection is its polygons; a vertex opposite the area is outside and not fatal."""
    shape = {"type": "Polygon", "coordinates": TOWER["geometry"]["coordinates"]}
    spot = {"type": "Point", "coordinates": [0.0001, 0.0001]}
    path = {"type": "LineString", "coordinates": [[0.0002, 0.0002], [0.0003, 0.0003]]}
    plain = feature("Point", [0.0001, 0.0001])
    features = [
        {**plain, "geometry": {"type": "GeometryCollection", "geometries": [spot, shape, path]}},
        {**plain, "geometry": {"type": "GeometryCollection", "geometries": [spot, path]}},
        {**plain, "geometry": {"type": "GeometryCollection", "geometries": []}},
        feature("LineString", [[-179.9995, -0.0005], [-179.9994, -0.0004]], width_m=1),
        feature("LineString", [[0.0005, 0.0005], [-179.9995, -0.0005]], width_m=1),
    ]
    result = run(spark, tmp_path, features)
    assert {r.pos for r in result.accepted.collect()} == {0, 1, 4}
    assert [r.reasons for r in result.issues.filter("severity = 'error'").collect()] == [["Empty geometry"]]
    cells = {r.feature: r["count"] for r in result.voxels.groupBy("feature").count().collect()}
    assert cells["0"] == 22 * 22 and set(cells) == {"0", "2"}


def test_lines_keep_their_order_in_any_split(spark, tmp_path):
    os.makedirs(tmp_path / "lines")
    for name, numbers in (("a", range(40)), ("b", range(40, 100))):
        (tmp_path / "lines" / f"{name}.json").write_text("".join(
            json.dumps({"area_id": "x", "id": n, "pos": 7 * n, **TOWER, "id": n}) + "\n" for n in numbers))
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = geojson.read_feature_lines(spark, str(tmp_path / "lines")).collect()
            numbered = geojson.read_feature_lines(spark, str(tmp_path / "lines"), numbered=True).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r.pos, r.id) for r in rows) == [(n, str(n)) for n in range(100)]
        assert sorted((r.pos, r.id) for r in numbered) == [(7 * n, str(n)) for n in range(100)]


def write_area(folder, stem, configuration, features):
    for kind, body in (("configs", configuration), ("features", {"features": features})):
        os.makedirs(folder / kind, exist_ok=True)
        (folder / kind / f"{stem}.json").write_text(json.dumps(body))


def read_areas(spark, folder):
    configs = config.read_configs(spark, str(folder / "configs"))
    return config.areas_of(configs), config.sources_of(configs)


def test_features_of_unknown_areas_are_violations(spark, tmp_path):
    write_area(tmp_path, "area", CONFIG, [TOWER])
    os.rename(tmp_path / "features" / "area.json", tmp_path / "features" / "arae.json")
    features = geojson.read_collections(spark, str(tmp_path / "features"))
    with pytest.raises(GateError, match="not configured .area arae"):
        build(*read_areas(spark, tmp_path), features)
    result = build(*read_areas(spark, tmp_path), features, on_violation="skip")
    assert [(r.area_id, r.message) for r in result.violations.collect()] == [
        ("arae", "Input names an area that is not configured")]


def test_areas_and_positions_are_unique(spark, tmp_path):
    write_area(tmp_path, "area", CONFIG, [TOWER])
    areas, sources = read_areas(spark, tmp_path)
    features = geojson.read_collections(spark, str(tmp_path / "features"))
    with pytest.raises(GateError, match="more than once"):
        build(areas.unionByName(areas), sources, features)
    with pytest.raises(GateError, match="more than one feature"):
        build(areas, sources, features.unionByName(features))


@pytest.mark.parametrize("change, message", [
    ({"max_voxels": "abc"}, "max_voxels must be a number"),
    ({"sources": [PLAN, {"url": "u", "license": "l"}]}, "needs an id"),
])
def test_unreadable_configuration_is_a_violation(spark, tmp_path, change, message):
    with pytest.raises(GateError, match=message):
        run(spark, tmp_path, [TOWER], {**CONFIG, **change})


def test_one_collection_over_several_areas(spark, tmp_path):
    for n in range(3):
        write_area(tmp_path, f"area{n}", {**CONFIG, "bbox": [0.0005 * n, 0, 0.0005 * n + 0.0005, 0.001]}, [])
    wide = feature("Polygon", [square(0.0002, 0.0004, 0.0008, 0.0005)])
    point = feature("Point", [0.0012, 0.0001], width_m=2)
    (tmp_path / "all.json").write_text(json.dumps({"features": [wide, point, feature("Polygon", [])]}))
    features = geojson.read_collections(spark, str(tmp_path / "all.json")).drop("area_id")
    result = build(*read_areas(spark, tmp_path), features)
    assert {(r.area_id, r.pos) for r in result.accepted.collect()} == {("area0", 0), ("area1", 0), ("area2", 1)}
    assert [(r.area_id, r.pos) for r in result.issues.filter("severity = 'error'").collect()] == [("area0", 2)]


def test_failing_publish_leaves_nothing(spark, tmp_path, monkeypatch):
    from lithogrid.plans import publish as sinks

    def fail(*_):
        raise RuntimeError("disk full")

    result = run(spark, tmp_path, [TOWER], evidence_path=str(tmp_path / "evidence"))
    monkeypatch.setattr(sinks, "checksums", fail)
    with pytest.raises(RuntimeError):
        publish(result, str(tmp_path / "out"))
    assert not [p for p in os.listdir(tmp_path) if p.startswith("out")]
    monkeypatch.undo()
    publish(result, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        publish(result, str(tmp_path / "out"))
    header = spark.read.json(str(tmp_path / "out" / "quality-report")).first()
    assert len(header.voxels_sha256) == 64 and header.voxel_files == 1
    assert not os.path.exists(result.work.path.removeprefix("file:"))
    kept = spark.read.parquet(str(tmp_path / "evidence" / "features"))
    assert json.loads(kept.first().properties)["source_id"] == "plan"
    assert spark.read.parquet(str(tmp_path / "evidence" / "sources")).first().license == "CC-BY-4.0"


def test_evidence_outlives_a_failed_run(spark, tmp_path):
    with pytest.raises(GateError):
        run(spark, tmp_path, [TOWER], {**CONFIG, "max_voxels": 1}, evidence_path=str(tmp_path / "evidence"))
    assert spark.read.parquet(str(tmp_path / "evidence" / "areas")).first().max_voxels == 1


def test_few_files_for_many_areas(spark, tmp_path):
    for n in range(12):
        write_area(tmp_path, f"area{n}", CONFIG, [TOWER])
    result = build(*read_areas(spark, tmp_path), geojson.read_collections(spark, str(tmp_path / "features")))
    publish(result, str(tmp_path / "out"))
    for name in ("features-local", "report-lists", "voxels"):
        files = [f for _, _, fs in os.walk(tmp_path / "out" / name) for f in fs if f.startswith("part-")]
        assert len(files) == 12, name


def test_osm_run(spark, tmp_path):
    def points(coordinates):
        return [{"lon": x, "lat": y} for x, y in coordinates]

    elements = [
        {"type": "way", "id": 1, "tags": {"building": "yes", "height": "4 m", "kind": "x"},
         "geometry": points(square(0.0004, 0.0004, 0.0006, 0.0006))},
        {"type": "way", "id": 2, "tags": {"highway": "path"}, "geometry": points(square(0.0001, 0.0001, 0.0002, 0.0002))},
        {"type": "way", "id": 3, "tags": {"building": "yes", "amenity": "parking"}, "geometry": points([(0.0001, 0.0001)])},
        {"type": "relation", "id": 4, "tags": {"type": "multipolygon", "natural": "water"},
         "bounds": {"minlon": 0, "minlat": 0, "maxlon": 0.001, "maxlat": 0.001}},
        {"type": "way", "id": 5, "tags": {"shop": "x"}, "geometry": points([(0, 0), (0.0005, 0.0005)])},
        {"type": "way", "id": 6, "tags": {"building": "no"}, "geometry": points(square(0.4, 0.4, 0.5, 0.5))},
        {"type": "node", "id": 7},
    ]
    os.makedirs(tmp_path / "osm")
    (tmp_path / "area.json").write_text(json.dumps({**CONFIG, "sources": []}))
    (tmp_path / "osm" / "area.json").write_text(json.dumps({"elements": elements}))
    configs = config.read_configs(spark, str(tmp_path / "area.json"))
    extracts = osm.read_extracts(spark, str(tmp_path / "osm"))
    result = build_from_osm(config.areas_of(configs), config.sources_of(configs), extracts)
    made = {r.feature: r for r in result.accepted.collect()}
    assert set(made) == {"osm/way/1", "osm/way/2"}
    assert (made["osm/way/1"].kind, made["osm/way/1"].height, made["osm/way/1"].geom_type) == ("building", 4.0, "Polygon")
    assert (made["osm/way/2"].kind, made["osm/way/2"].geom_type) == ("path", "LineString")
    assert {(r.id, r.reason) for r in result.skipped.collect()} == {
        (3, "missing geometry"), (4, "multipolygon requires curated geometry")}
    assert result.headers.first().skipped_osm == 2

    (tmp_path / "osm" / "area.json").write_text(json.dumps({"remark": "timed out", "elements": elements}))
    with pytest.raises(GateError, match="incomplete data: timed out"):
        build_from_osm(config.areas_of(configs), config.sources_of(configs),
                       osm.read_extracts(spark, str(tmp_path / "osm")))


def test_large_features_in_a_run(spark, tmp_path):
    """More than 64 edges: grid validity, exploded spans, whole export."""
    import math

    def circle(radius, n=90, east=0.0005):
        ring = [[east + radius * math.cos(2 * math.pi * i / n), 0.0005 + radius * math.sin(2 * math.pi * i / n)]
                for i in range(n)]
        return ring + ring[:1]

    crossed = circle(0.0001)
    crossed[10], crossed[50] = crossed[50], crossed[10]
    wave = [[0.0001 + 0.000008 * i, 0.0005 + 0.0001 * math.sin(i / 5)] for i in range(100)]
    features = [feature("Polygon", [circle(0.0002), circle(0.0001)]), feature("Polygon", [crossed]),
                feature("LineString", wave, width_m=2), feature("Polygon", [circle(0.0001, east=0.005)])]
    result = run(spark, tmp_path, features)
    assert {r.pos: r.feature for r in result.accepted.collect()} == {0: "0", 2: "1"}
    assert {r.pos: r.severity for r in result.issues.collect()} == {1: "error"}
    cells = {r.feature: r["count"] for r in result.voxels.groupBy("feature").count().collect()}
    # A ring between 22.2 m and 11.1 m, and two metres along the wave.
    assert cells["0"] == pytest.approx(math.pi * (22.2**2 - 11.1**2), rel=0.02)
    assert cells["1"] == pytest.approx(2 * sum(
        math.dist((a[0] * 111320, a[1] * 110574), (b[0] * 111320, b[1] * 110574)) for a, b in zip(wave, wave[1:])), rel=0.1)
    publish(result, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "features-local")).collect()]
    assert {len(f["geometry"]["coordinates"]) for f in lines if f["geometry"]["type"] == "Polygon"} == {2}


def test_files_in_order_over_several_tasks(spark, tmp_path):
    """By name, the files of an area are in order of feature, x, z and y."""
    features = [{**feature("Polygon", [square(0.0001 * k, 0.0001, 0.0001 * k + 0.0002, 0.0003)], height_m=3), "id": f"f{k}"} for k in range(5)]
    result = run(spark, tmp_path, features)
    place = {f"f{k}": k for k in range(5)}
    publish(result, str(tmp_path / "out"), "json", rows_per_file=300, ordered=True)
    files = sorted((tmp_path / "out" / "voxels").glob("area_id=*/part-*.json"))
    assert len({f.name.split("-")[1] for f in files}) > 3
    rows = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    keys = [(place[r["feature"]], r["x"], r["z"], r["y"]) for r in rows]
    assert len(keys) > 1000 and keys == sorted(keys)


def test_extracts_are_kept_as_read(spark, tmp_path):
    """Also when a gate fails, and with the elements read by many tasks."""
    extract = {"remark": "cut short", "elements": [
        {"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": [{"lon": 0.0004, "lat": 0.0004}, {"lon": 0.0006, "lat": 0.0004}]},
        {"type": "node", "id": 2}]}
    (tmp_path / "osm").mkdir()
    (tmp_path / "osm" / "area.json").write_text(json.dumps(extract))
    (tmp_path / "area.json").write_text(json.dumps(CONFIG))
    configs = config.read_configs(spark, str(tmp_path / "area.json"))
    inputs = config.areas_of(configs), config.sources_of(configs)
    whole = osm.read_extracts(spark, str(tmp_path / "osm"))
    with pytest.raises(GateError, match="incomplete data"):
        build_from_osm(*inputs, whole, evidence_path=str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept" / "extracts"))
    assert kept.collect() == whole.collect()
    remarks, elements = osm.read_large_extracts(spark, str(tmp_path / "osm"))
    with pytest.raises(GateError, match="incomplete data"):
        build_from_osm(*inputs, remarks, elements=elements, evidence_path=str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts" / "elements")).count() == 2
    assert spark.read.parquet(str(tmp_path / "parts" / "extracts")).first().remark == "cut short"
