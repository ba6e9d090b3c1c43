"""Operators against brute force, and their large-scale forms against the small ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithogrid.functions.geodesy import azimuthal_equidistant
from lithogrid.operators import areas as area_ops
from lithogrid.operators import evidence, local_geometry, numbering, raster, report, ring_nesting, validity
from lithogrid.operators.lookup import lookup
from lithogrid.plans import derived
from lithogrid.plans.build import large_spans, small_spans
from lithogrid.plans.workspace import Workspace

KEEP = ["area_id", "pos", "y0", "y1"]
RING = "part INT, ring INT, lon ARRAY<DOUBLE>, lat ARRAY<DOUBLE>"


def framed_area(spark, size=1.0):
    area = spark.createDataFrame([("a", 7.0, 48.0, 7.001, 48.001, size)],
                                 "area_id STRING, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, voxel_size_m DOUBLE")
    return area_ops.frame_areas(area)


def with_frame(spark, features, size=1.0):
    """Rows (pos, geom_type, width, rings) made ready for the span operators."""
    rows = spark.createDataFrame(
        features, f"pos BIGINT, geom_type STRING, width DOUBLE, rings ARRAY<STRUCT<{RING}>>")
    ready = rows.select(
        F.lit("a").alias("area_id"), "*", F.lit(0.0).alias("base"), F.lit(1.0).alias("height"),
        F.lit(False).alias("malformed"), F.lit(True).alias("usable"), F.lit(True).alias("accepted"),
        F.col("geom_type").isin("LineString", "Point").alias("thick"))
    framed = area_ops.attach_frame(local_geometry.with_outline(ready), framed_area(spark, size))
    return raster.with_layers(framed)


def cells(spans):
    rows = spans.select("pos", "x", F.explode(F.sequence("z0", "z1")).alias("z")).collect()
    unique = {(r.pos, r.x, r.z) for r in rows}
    assert len(unique) == len(rows), "spans overlap"
    return unique


def random_features(seed, kind, n, vertices):
    rng = random.Random(seed)
    out = []
    for pos in range(n):
        cx, cy = 7.0 + rng.uniform(-2e-4, 1.2e-3), 48.0 + rng.uniform(-2e-4, 1.2e-3)
        if kind == "Polygon":
            angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(vertices))
            ring = [(cx + rng.uniform(1e-5, 3e-4) * math.cos(a), cy + rng.uniform(1e-5, 3e-4) * math.sin(a)) for a in angles]
            ring.append(ring[0])
        else:
            ring = [(cx + rng.uniform(-3e-4, 3e-4), cy + rng.uniform(-3e-4, 3e-4)) for _ in range(vertices)]
        out.append((pos, kind if vertices > 1 else "Point", rng.uniform(0.5, 6),
                    [(0, 0, [p[0] for p in ring], [p[1] for p in ring])]))
    return out


def brute_cells(features, size=1.0):
    """Every centre of the area against every edge, in numpy."""
    lon0, lat0 = (7.0 + 7.001) / 2, (48.0 + 48.001) / 2
    qx, qz = project([7.0, 7.001, 7.001, 7.0], [48.0, 48.0, 48.001, 48.001], lon0, lat0)
    xs = np.arange(math.floor(qx.min() / size) - 1, math.ceil(qx.max() / size) + 1)
    zs = np.arange(math.floor(qz.min() / size) - 1, math.ceil(qz.max() / size) + 1)
    gx, gz = (g * size + size / 2 for g in np.meshgrid(xs, zs, indexing="ij"))
    inside = np.ones(gx.shape, bool)
    sides = []
    for i in range(4):
        j = (i + 1) % 4
        sides.append((qx[j] - qx[i], qz[j] - qz[i], qx[i], qz[i]))
        inside &= sides[-1][0] * (gz - qz[i]) - sides[-1][1] * (gx - qx[i]) >= 0
    found = set()
    for pos, kind, width, rings in features:
        hit = np.zeros(gx.shape, bool)
        for _, _, lon, lat in rings:
            x, z = project(lon, lat, lon0, lat0)
            if kind == "Polygon":
                for x1, z1, x2, z2 in zip(x[:-1], z[:-1], x[1:], z[1:]):
                    with np.errstate(all="ignore"):
                        hit ^= ((x1 <= gx) != (x2 <= gx)) & (gz < z1 + (z2 - z1) * ((gx - x1) / (x2 - x1)))
            else:
                pairs = list(zip(x[:-1], z[:-1], x[1:], z[1:])) or [(x[0], z[0], x[0], z[0])]
                for x1, z1, x2, z2 in pairs:
                    t0, t1 = 0.0, 1.0
                    for dx, dz, ox, oz in sides:
                        f = dx * (z1 - oz) - dz * (x1 - ox)
                        g = dx * (z2 - oz) - dz * (x2 - ox)
                        if f < 0 and g < 0:
                            t0, t1 = 1.0, 0.0
                        elif f < 0:
                            t0 = max(t0, f / (f - g))
                        elif g < 0:
                            t1 = min(t1, f / (f - g))
                    if t0 > t1:
                        continue
                    px, pz, ux, uz = x1 + t0 * (x2 - x1), z1 + t0 * (z2 - z1), (t1 - t0) * (x2 - x1), (t1 - t0) * (z2 - z1)
                    length = ux * ux + uz * uz
                    t = np.clip(((gx - px) * ux + (gz - pz) * uz) / length, 0, 1) if length else 0.0
                    hit |= (gx - px - t * ux) ** 2 + (gz - pz - t * uz) ** 2 <= (width / 2) ** 2
        found |= {(pos, int(xs[i]), int(zs[j])) for i, j in zip(*np.nonzero(hit & inside))}
    return found


def project(lon, lat, lon0, lat0):
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    return azimuthal_equidistant(lon, lat, np.full(len(lon), lon0), np.full(len(lon), lat0))


@pytest.mark.parametrize("kind, vertices, size", [
    ("Polygon", 3, 1.0), ("Polygon", 9, 0.7), ("LineString", 2, 1.0), ("LineString", 6, 2.5), ("Point", 1, 0.5)])
def test_spans_match_brute_force(spark, kind, vertices, size):
    features = random_features(vertices, kind, 25, vertices)
    ready = with_frame(spark, features, size)
    in_row = cells(small_spans(local_geometry.project_in_row(ready), KEEP))
    exploded = cells(large_spans(ready, KEEP))
    expected = brute_cells(features, size)
    assert in_row == expected
    assert exploded == expected


def test_chunks_share_vertices(spark):
    features = random_features(5, "Polygon", 3, 40)
    ready = with_frame(spark, features)
    whole = local_geometry.chunk_edges(ready).select("pos", "e").collect()
    cut = local_geometry.chunk_edges(ready, chunk=7).select("pos", "e").collect()
    assert len(whole) == len(cut) == 3 * 40
    assert cells(raster.large_polygon_spans(local_geometry.chunk_edges(ready, chunk=7))) == brute_cells(features)


def test_contact_agrees_between_paths(spark):
    features = random_features(11, "Polygon", 40, 5)
    around = [(100, "Polygon", 0.0, [(0, 0, [6.9, 7.1, 7.1, 6.9, 6.9], [47.9, 47.9, 48.1, 48.1, 47.9])]),
              (101, "Polygon", 0.0, [(0, 0, [6.9, 6.95, 6.95, 6.9, 6.9], [47.9, 47.9, 48.1, 48.1, 47.9])])]
    ready = with_frame(spark, features + around)
    small = {r.pos: r.in_area for r in local_geometry.touches_area(local_geometry.project_in_row(ready)).collect()}
    large = {r.pos: r.in_area for r in local_geometry.large_contact(local_geometry.chunk_edges(ready)).collect()}
    assert small == large
    assert small[100] and not small[101]


def test_boundary_centres_count_as_inside(spark):
    """Edges exactly on cell centres, which only made-up local coordinates have."""
    edges = [(0.5, 0.5, 3.5, 0.5), (3.5, 0.5, 3.5, 2.5), (3.5, 2.5, 0.5, 2.5), (0.5, 2.5, 0.5, 0.5)]
    ready = with_frame(spark, [(0, "Polygon", 0.0, [(0, 0, [7.0, 7.0, 7.0, 7.0, 7.0], [48.0] * 5)])])
    local = ready.withColumn("edges", F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("x1", "z1", "x2", "z2"), e)]) for e in edges])).withColumn(
        "x", F.array(*[F.lit(e[0]) for e in edges]))
    expected = {(0, x, z) for x in range(4) for z in range(3)}
    assert cells(raster.polygon_spans(local, KEEP)) == expected
    assert cells(raster.large_polygon_spans(local.withColumn("e", F.explode("edges")))) == expected


def test_flinders_peak_to_buninyong():
    x, z = azimuthal_equidistant(np.array([143.92649552777777]), np.array([-37.65282113888889]),
                                 np.array([144.42486788888888]), np.array([-37.951033416666665]))
    assert np.hypot(x, z)[0] == pytest.approx(54972.271, abs=1e-3)
    assert math.degrees(math.atan2(x[0], z[0])) % 360 == pytest.approx(306.86816, abs=1e-5)


def test_vertices_opposite_the_centre_lie_far_outside():
    lon, lat = np.array([179.4, 179.5, 0.0, np.nan]), np.array([-51.3, -51.4, 51.0, 1.0])
    x, z = azimuthal_equidistant(lon, lat, np.full(4, -0.5), np.full(4, 51.4))
    assert (np.hypot(x, z)[:2] > 19.9e6).all() and np.hypot(x, z)[2] < 1e5 and np.isnan(x[3])


def test_validity_paths_agree(spark):
    """Shapes of every kind, judged in the row and on the grid."""
    shapes = [(pos, "Polygon", 0.0, [(0, k, [float(u) for u, _ in ring], [float(v) for _, v in ring])
                                     for k, ring in enumerate(rings)]) for pos, rings in derived.SHAPES.items() if pos != 3]
    parts = [(50, [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(3, 3), (4, 3), (4, 4), (3, 3)]]),
             (51, [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (4, 3), (4, 4), (3, 3)]]),
             (52, [[(8, 8), (7, 9), (7, 7), (8, 8)], [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 20), (10, 3), (4, 40), (2, 20)]])]
    ring = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
    holed = {60: [ring, [(30, 30), (25, 31), (28, 35), (30, 30)]],                                          # outside
             61: [ring, [(2, 3), (8, 3), (8, 9), (2, 9), (2, 3)], [(5, 5), (3, 4), (4, 6), (5, 5)]],          # nested
             62: [ring, [(5, 0), (9, 9), (20, 5), (5, 0)]],                                                  # cut off
             63: [ring, [(10, 5), (12, 7), (10, 9), (8, 7), (10, 5)], [(10, 9), (12, 7), (14, 9), (10, 9)]]}  # cut off
    shapes += [(pos, "Polygon", 0.0, [(0, k, [float(u) for u, _ in r], [float(v) for _, v in r]) for k, r in enumerate(rings)])
               for pos, rings in holed.items()]
    multis = [(pos, "MultiPolygon", 0.0, [(k, 0, [float(u) for u, _ in ring], [float(v) for _, v in ring])
                                          for k, ring in enumerate(rings)]) for pos, rings in parts]
    ready = local_geometry.with_outline(spark.createDataFrame(
        shapes + multis, f"pos BIGINT, geom_type STRING, width DOUBLE, rings ARRAY<STRUCT<{RING}>>").withColumn(
        "area_id", F.lit("a")).withColumn("malformed", F.lit(False)))
    small = {r.pos: r.error for r in validity.check_in_row(ready, 64).collect() if r.error}
    large = {r.pos: r.error for r in validity.check_large(ready, Workspace(spark).save).collect()}
    assert small == large
    assert small[60] == "Hole lies outside shell[25 31]" and small[61] == "Holes are nested[3 4]"
    names = {pos: error.split("[")[0] for pos, error in small.items()}
    assert names == {2: "Self-intersection", 4: "Ring Self-intersection", 5: "Hole lies outside shell",
                     6: "Holes are nested", 7: "Self-intersection", 9: "Interior is disconnected", 51: "Nested shells",
                     52: "Self-intersection", 60: "Hole lies outside shell", 61: "Holes are nested",
                     62: "Interior is disconnected", 63: "Self-intersection"}
    assert small[2] == "Self-intersection[2 2]"


def test_nested_shells_that_touch_at_their_first_vertices(spark):
    """Only the fourth vertex of the inner shell lies off the outer outline."""
    shells = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(5, 0), (10, 5), (5, 10), (2, 5), (5, 0)]]
    ready = local_geometry.with_outline(spark.createDataFrame(
        [(0, "MultiPolygon", 0.0, [(k, 0, [float(u) for u, _ in r], [float(v) for _, v in r]) for k, r in enumerate(shells)])],
        f"pos BIGINT, geom_type STRING, width DOUBLE, rings ARRAY<STRUCT<{RING}>>").withColumn(
        "area_id", F.lit("a")).withColumn("malformed", F.lit(False)))
    small = [r.error for r in validity.check_in_row(ready, 64).collect()]
    large = [r.error for r in validity.check_large(ready, Workspace(spark).save).collect()]
    assert small == large == ["Nested shells[2 5]"]


def polygons(spark, shapes):
    """Features of (pos, rings of one part)."""
    rows = [(pos, "Polygon", 0.0, [(0, k, [float(u) for u, _ in r], [float(v) for _, v in r]) for k, r in enumerate(rings)])
            for pos, rings in shapes]
    return local_geometry.with_outline(spark.createDataFrame(
        rows, f"pos BIGINT, geom_type STRING, width DOUBLE, rings ARRAY<STRUCT<{RING}>>").withColumn(
        "area_id", F.lit("a")).withColumn("malformed", F.lit(False)))


def closed(*points):
    return [*points, points[0]]


def test_interiors_cut_off_by_a_cycle_of_rings(spark):
    """Holes that touch one after the other: a chain is sound, a ring of them cuts the interior."""
    shell = closed((0, 0), (20, 0), (20, 20), (0, 20))
    three = [closed((6, 6), (10, 5), (14, 6), (10, 7)), closed((14, 6), (15, 10), (10, 14), (13, 10)), closed((10, 14), (6, 10), (6, 6), (7, 10))]
    four = [closed((5, 5), (10, 4), (15, 5), (10, 6)), closed((15, 5), (16, 10), (15, 15), (14, 10)),
            closed((15, 15), (10, 16), (5, 15), (10, 14)), closed((5, 15), (4, 10), (5, 5), (6, 10))]
    through_shell = [closed((0, 8), (5, 6), (5, 10)), closed((5, 8), (10, 6), (10, 10)), closed((10, 8), (15, 0), (14, 9))]
    tail = closed((2, 2), (5, 5), (3, 4))  # hangs on the cycle at its smallest point
    star = [closed((10, 10), (12, 16), (10, 17), (9, 16)), closed((10, 10), (16, 11), (17, 10), (16, 9)), closed((10, 10), (4, 9), (3, 10), (4, 11))]
    shapes = [(0, [shell, *three]), (1, [shell, *three[:2]]), (2, [shell, *four]), (3, [shell, *four[:3]]), (4, [shell, *through_shell]),
              (5, [shell, *through_shell[:2]]), (6, [shell, *four, tail]), (7, [shell, *star])]
    ready = polygons(spark, shapes)
    small = {r.pos: r.error for r in validity.check_in_row(ready, 64).collect() if r.error}
    large = {r.pos: r.error for r in validity.check_large(ready, Workspace(spark).save).collect()}
    assert small == large == {0: "Interior is disconnected[6 6]", 2: "Interior is disconnected[5 5]",
                              4: "Interior is disconnected[0 8]", 6: "Interior is disconnected[5 5]"}


def fan(count, far=0.0):
    """A shell with thin holes that all end at one vertex, a little apart from each other."""
    shell = closed((-50, -50), (50 + far, -50), (50, 50), (-50, 50))
    holes = []
    for k in range(count):
        a, b = 2 * math.pi * k / count, 2 * math.pi * (k + 0.4) / count
        holes.append(closed((0, 0), (40 * math.cos(a), 40 * math.sin(a)), (40 * math.cos(b), 40 * math.sin(b))))
    return [shell, *holes]


def squares(count, far):
    """Small holes in a row, and a vertex of the shell far away."""
    shell = closed((-1, -1), (far, -1), (count + 1, 2), (-1, 2))
    return [shell, *(closed((k, 0), (k + 0.5, 0), (k + 0.5, 0.5), (k, 0.5)) for k in range(count))]


def pairs_of(spark, shape):
    edges = validity.large_ring_edges(polygons(spark, [(0, shape)]))
    save = Workspace(spark).save
    arms = save(validity.hub_arms(edges), "arms")
    cells = validity._divide(validity._over_grid(validity._with_hubs(edges, arms)), save)
    return validity.edge_pairs(cells).count()


def test_crowded_places_make_few_pairs(spark):
    """Edges at one vertex and holes under one far vertex: pairs grow about as the edges do."""
    for shape in (fan, lambda n: squares(n, 1e6)):
        few, many = pairs_of(spark, shape(100)), pairs_of(spark, shape(400))
        assert many <= 8 * max(few, 400)
    shapes = [(0, fan(400)), (1, squares(600, 1e6)), (2, fan(400) + [closed((60, 0), (61, 0), (61, 1))]),
              (3, squares(600, 1e6) + [closed((5.1, 0.1), (5.2, 0.1), (5.2, 0.2))]),
              (4, fan(40) + [closed((0, 0), (30, 1), (30, 9))]), (5, fan(40) + [closed((0, 0), (30, 0), (31, 0.5))]),
              (6, fan(40)[:1] + [closed((0, 0), (9, 0), (9, 1), (0, 0), (-9, 0), (-9, 1))] + fan(40)[2:])]
    found = {r.pos: r.error for r in validity.check_large(polygons(spark, shapes), Workspace(spark).save).collect()}
    assert {p: e.split("[")[0] for p, e in found.items()} == {
        2: "Hole lies outside shell", 3: "Holes are nested", 4: "Self-intersection", 5: "Self-intersection", 6: "Self-intersection"}
    assert found[3] == "Holes are nested[5.1 0.1]"


def test_sweep_nests_rings_as_brute_force_does():
    rng = np.random.default_rng(7)
    for _ in range(30):
        # squares in squares, in any direction and order
        boxes, waiting = [], [(0.0, 0.0, 100.0, None)]
        while waiting and len(boxes) < 25:
            x, y, side, up = waiting.pop(0)
            n = len(boxes)
            boxes.append((x, y, side, up))
            for cx in range(2):
                for cy in range(2):
                    if rng.random() < 0.6:
                        waiting.append((x + side * (0.1 + 0.45 * cx), y + side * (0.1 + 0.45 * cy), side * 0.3, n))
        rows = []
        for n, (x, y, side, _) in enumerate(boxes):
            ring = [(x, y), (x + side, y + side / 9), (x + side, y + side), (x + side / 9, y + side)][:: rng.choice([-1, 1])]
            rows += [(n, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
        columns = [np.array(c, float) for c in zip(*rows)]
        found = ring_nesting.parents(columns[0].astype(int), *columns[1:], set())
        assert found == {n: up for n, (_, _, _, up) in enumerate(boxes)}


def test_crowded_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(validity, "MAX_EDGES_IN_CELL", 4)
    angles = [2 * math.pi * i / 200 for i in range(200)]
    ring = [(math.cos(a) * (1 + i % 2), math.sin(a) * (1 + i % 2)) for i, a in enumerate(angles)]
    bad = ring[:100] + [(0.0, 50.0)] + ring[100:]
    rows = [(pos, "Polygon", 0.0, [(0, 0, [x for x, _ in r + r[:1]], [y for _, y in r + r[:1]])])
            for pos, r in enumerate((ring, bad))]
    ready = local_geometry.with_outline(spark.createDataFrame(
        rows, f"pos BIGINT, geom_type STRING, width DOUBLE, rings ARRAY<STRUCT<{RING}>>").withColumn(
        "area_id", F.lit("a")).withColumn("malformed", F.lit(False)))
    found = validity.check_large(ready, Workspace(spark).save).collect()
    assert [r.pos for r in found] == [1]


def test_lookup_salts_beyond_the_broadcast_bound(spark):
    big = spark.range(1000).selectExpr("id AS pos", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL "
                                       "ELSE concat('k', id % 5) END AS k")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k STRING, v INT")
    for how in ("left", "inner"):
        assert sorted(map(str, lookup(big, small, ["k"], how, broadcast=True).collect())) == sorted(
            map(str, lookup(big, small, ["k"], how, broadcast=False).collect()))


def test_running_count_across_blocks(spark):
    rows = spark.range(500).selectExpr("'a' AS area_id", "id * 3 AS pos", "id % 4 <> 0 AS accepted")
    for broadcast in (True, False):
        out = {r.pos: r.accepted_before for r in numbering.with_accepted_before(rows, 4, broadcast).collect()}
        expected, n = {}, 0
        for i in range(500):
            expected[i * 3] = n
            n += i % 4 != 0
        assert out == expected


def test_list_pieces_hold_everything(spark):
    issues = spark.range(10_000).selectExpr("'a' AS area_id", "id AS pos", "concat('f', id) AS feature",
                                            "'warning' AS severity", "array('r') AS reasons")
    none = spark.createDataFrame([], "area_id STRING, pos BIGINT, id BIGINT, reason STRING, raw STRING")
    pieces = report.list_pieces(none, issues, none).collect()
    assert sum(len(p.entries) for p in pieces) == 10_000
    assert max(len(p.entries) for p in pieces) <= 2**report.PIECE_BITS


@pytest.mark.parametrize("text, value", [
    ("3", 3.0), (" 3.5 ", 3.5), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("+4", 4.0), ("1e3", 1000.0),
    ("inf", math.inf), ("-Infinity", -math.inf), ("3d", None), ("0x1p3", None), ("", None), ("1__0", None)])
def test_parse_float(spark, text, value):
    from lithogrid.functions.values import parse_float
    assert spark.range(1).select(parse_float(F.lit(text)).alias("v")).first().v == value


def test_small_spans_need_no_shuffle(spark):
    """From the scan to the spans of small features there is no exchange but broadcasts."""
    ready = with_frame(spark, random_features(1, "Polygon", 2, 4)).filter("accepted")
    spans = raster.polygon_spans(local_geometry.edges_in_row(local_geometry.project_in_row(ready)), KEEP)
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan


def test_evidence_flags(spark):
    rows = spark.createDataFrame(
        [(0, "Polygon", '{"height_m": null, "height": 5, "base_elevation_m": 1}'),
         (1, "Polygon", '{"height_m": true, "base_elevation_m": true}'),
         (2, "Polygon", '{"height": "7 m", "base_elevation_m": "10 m"}'),
         (3, "Point", '{"kind": null, "height_m": 2, "base_elevation_m": -0.5}')],
        "pos BIGINT, geom_type STRING, p STRING").withColumn("properties", F.parse_json("p")).drop("p")
    out = {r.pos: r for r in evidence.resolve_evidence(rows).collect()}
    assert (out[0].height, out[0].assumptions) == (1.0, [evidence.HEIGHT_ASSUMED])
    assert (out[1].height, out[1].base, out[1].assumptions) == (1.0, 1.0, [evidence.HEIGHT_UNREADABLE])
    assert (out[2].height, out[2].base) == (7.0, None)
    assert (out[3].kind, out[3].width, out[3].base) == (None, 1.0, -0.5)


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)

    def boxes(n, scale):
        out = []
        for i in range(n):
            west, south, w, h = rng.uniform(-1, 1), rng.uniform(-1, 1), *(10 ** rng.uniform(*scale) for _ in "wh")
            out.append((i, west, south, west + w, south + h))
        return out

    features, areas = boxes(200, (-5, 0.5)), boxes(40, (-3, 0.7))
    box = "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE"
    f = spark.createDataFrame(features, f"pos BIGINT, {box}")
    a = spark.createDataFrame([(str(i), *b) for i, *b in areas], f"area_id STRING, {box}")
    expected = {(i, str(j)) for i, w, s, e, n in features for j, w2, s2, e2, n2 in areas
                if w <= e2 and e >= w2 and s <= n2 and n >= s2}
    for broadcast in (True, False):
        rows = [(r.pos, r.area_id) for r in area_ops.pair_areas(f, a, broadcast=broadcast).collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == expected


def test_pairing_makes_no_product_with_a_world_wide_area(spark):
    features = spark.range(2000).selectExpr(
        "id AS pos", "cast(id % 50 AS DOUBLE) AS west", "cast(floor(id / 50) AS DOUBLE) AS south").selectExpr(
        "*", "west + 0.01 AS east", "south + 0.01 AS north")
    small = spark.range(500).selectExpr(
        "concat('a', id) AS area_id", "cast(id % 25 AS DOUBLE) + 0.005 AS west", "cast(floor(id / 25) AS DOUBLE) AS south"
    ).selectExpr("*", "west + 0.02 AS east", "south + 0.02 AS north")
    world = spark.createDataFrame([("world", -180.0, -89.0, 180.0, 89.0)], small.schema)
    boxes = small.unionByName(world)
    pairs = area_ops.pair_areas(features, boxes)
    found = pairs.count()
    assert found == 2500 and pairs.distinct().count() == found
    assert area_ops.level_joins(features, boxes).count() < 2 * found


def test_pairing_repeats_no_cells_of_60000_areas(spark):
    """Their cells are broadcast once instead of shuffled 32 times."""
    size = ["west + 0.03 + id % 4 * 0.2 AS east", "south + 0.03 + id % 4 * 0.2 AS north"]
    boxes = spark.range(60_000).selectExpr("id", "cast(id * 53 % 4000 AS DOUBLE) / 100 AS west", "cast(id * 31 % 2000 AS DOUBLE) / 100 AS south")
    areas = boxes.selectExpr("concat('a', id) AS area_id", "west", "south", *size)
    features = boxes.limit(10).selectExpr("id AS pos", "west", "south", "west AS east", "south AS north")
    pairs = area_ops.pair_areas(features, areas)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and plan.count("broadcast") == 2
    expected = features.join(areas.select("area_id", *[F.col(c).alias(f"a_{c}") for c in ("west", "south", "east", "north")]), F.expr(
        "west <= a_east AND east >= a_west AND south <= a_north AND north >= a_south"))
    assert sorted((r.pos, r.area_id) for r in pairs.collect()) == sorted((r.pos, r.area_id) for r in expected.collect())


def test_salted_lookups_broadcast_neither_side(spark, tmp_path):
    """Files of a few kB say nothing about the rows that are made of them."""
    for name in ("big", "small"):
        spark.range(10).select(F.col("id").alias("pos")).write.parquet(f"{tmp_path}/{name}")
    rows = {name: spark.read.parquet(f"{tmp_path}/{name}").withColumn("area_id", F.lit("a")) for name in ("big", "small")}
    joined = lookup(rows["big"], rows["small"].select("area_id", F.col("pos").alias("n")), ["area_id"], "inner", broadcast=False)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
