"""Geometry validity on the longitudes and latitudes as given.

Small features are judged inside their row. For large ones the edges are laid
over a grid fitted to the feature and only edges that share a cell are
compared; a sweep tells how its rings lie in each other.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.functions.planar import let
from lithogrid.operators import ring_nesting

# Reason texts.
EMPTY = "Empty geometry"
TOO_FEW_POINTS = "Too few points in geometry component"
SELF_INTERSECTION = "Self-intersection"
RING_SELF_INTERSECTION = "Ring Self-intersection"
HOLE_OUTSIDE = "Hole lies outside shell"
NESTED_HOLES = "Holes are nested"
DISCONNECTED = "Interior is disconnected"
NESTED_SHELLS = "Nested shells"

_AREAL = "geom_type IN ('Polygon', 'MultiPolygon')"
_LINEAR = "geom_type IN ('LineString', 'MultiLineString')"

# --- edges --------------------------------------------------------------------------------------

# Vertices of a ring without immediate repetitions.
_DISTINCT = """transform(rings, (g, k) -> named_struct('g', k, 'part', g.part, 'ring', g.ring,
  'lon', g.lon, 'lat', g.lat, 'keep', filter(sequence(0, size(g.lon) - 1), i ->
     CASE WHEN i = 0 THEN true ELSE g.lon[i] <> g.lon[i - 1] OR g.lat[i] <> g.lat[i - 1] END)))"""

_POINTS = f"""transform({_DISTINCT}, d -> named_struct('g', d.g, 'part', d.part, 'ring', d.ring,
  'x', transform(d.keep, i -> d.lon[i]), 'y', transform(d.keep, i -> d.lat[i])))"""

# An edge knows its ring, its place there, its box and the vertex before it.
_RING_EDGES = """transform(sequence(1, size(d.x) - 1), i -> named_struct(
  'g', d.g, 'part', d.part, 'ring', d.ring, 'i', i, 'n', size(d.x) - 1,
  'x1', d.x[i - 1], 'y1', d.y[i - 1], 'x2', d.x[i], 'y2', d.y[i],
  'px', CASE WHEN i = 1 THEN d.x[size(d.x) - 2] ELSE d.x[i - 2] END,
  'py', CASE WHEN i = 1 THEN d.y[size(d.x) - 2] ELSE d.y[i - 2] END,
  'xl', least(d.x[i - 1], d.x[i]), 'xh', greatest(d.x[i - 1], d.x[i]),
  'yl', least(d.y[i - 1], d.y[i]), 'yh', greatest(d.y[i - 1], d.y[i])))"""
_EDGES = f"flatten(transform(filter(points, d -> size(d.x) > 1), d -> {_RING_EDGES}))"


def _number(value: str) -> str:
    return f"regexp_replace(cast(round({value}, 12) AS STRING), '[.]0$', '')"


def _at(reason: str, x: str, y: str) -> str:
    return f"concat('{reason}[', {_number(x)}, ' ', {_number(y)}, ']')"


# --- two edges ----------------------------------------------------------------------------------

BOXES_MEET = "a.xl <= b.xh AND b.xl <= a.xh AND a.yl <= b.yh AND b.yl <= a.yh"


def _side(p: str, x: str, y: str) -> str:
    return f"({p}.x2 - {p}.x1) * ({y} - {p}.y1) - ({p}.y2 - {p}.y1) * ({x} - {p}.x1)"


# Sides of the ends of one edge as seen along the other.
SIDES = ("named_struct('b1', {}, 'b2', {}, 'a1', {}, 'a2', {})".format(
    _side("a", "b.x1", "b.y1"), _side("a", "b.x2", "b.y2"),
    _side("b", "a.x1", "a.y1"), _side("b", "a.x2", "a.y2")))


def _within(p: str, x: str, y: str) -> str:
    return f"{x} BETWEEN {p}.xl AND {p}.xh AND {y} BETWEEN {p}.yl AND {p}.yh"


_CROSSING, _RING_TOUCH, _OUT, _IN_OTHER_HOLE, _IN_OTHER_SHELL, _APART, _RINGS_MEET = 1, 2, 3, 4, 5, 6, 9
# The reason of the lowest rank is reported, at its smallest point.
_RANKED = {_CROSSING: SELF_INTERSECTION, _RING_TOUCH: RING_SELF_INTERSECTION, _OUT: HOLE_OUTSIDE,
           _IN_OTHER_HOLE: NESTED_HOLES, _IN_OTHER_SHELL: NESTED_SHELLS, _APART: DISCONNECTED}
_HIT = "named_struct('code', {}, 'x', {}, 'y', {}, 'ga', a.g, 'gb', b.g, 'pa', a.part, 'pb', b.part)"
_ADJACENT = "(abs(a.i - b.i) = 1 OR abs(a.i - b.i) = a.n - 1)"

# The single common point when an end of one edge lies on the other.
_TOUCH_POINT = f"""CASE
  WHEN o.b1 = 0 AND {_within('a', 'b.x1', 'b.y1')} THEN named_struct('x', b.x1, 'y', b.y1)
  WHEN o.b2 = 0 AND {_within('a', 'b.x2', 'b.y2')} THEN named_struct('x', b.x2, 'y', b.y2)
  WHEN o.a1 = 0 AND {_within('b', 'a.x1', 'a.y1')} THEN named_struct('x', a.x1, 'y', a.y1)
  WHEN o.a2 = 0 AND {_within('b', 'a.x2', 'a.y2')} THEN named_struct('x', a.x2, 'y', a.y2) END"""


def _bearing(x: str, y: str) -> str:
    return f"atan2({y} - t.y, {x} - t.x)"


def _turn(from_bearing: str, to_bearing: str) -> str:
    return f"pmod({to_bearing} - {from_bearing}, {2 * 3.141592653589793}D)"


# Different rings that share a vertex cross when the arms of one lie on both
# sides of the other. Judged where the vertex is the start of its edge.
_ARM = {p: (f"CASE WHEN t.x = {p}.x1 AND t.y = {p}.y1 THEN {p}.px ELSE {p}.x1 END",
            f"CASE WHEN t.x = {p}.x1 AND t.y = {p}.y1 THEN {p}.py ELSE {p}.y1 END") for p in "ab"}
_ENDS_HERE = "((t.x = a.x2 AND t.y = a.y2) OR (t.x = b.x2 AND t.y = b.y2))"
_ARMS_CROSS = let(
    "q",
    "named_struct('full', {}, 'b0', {}, 'b1', {})".format(
        _turn(_bearing(*_ARM["a"]), _bearing("a.x2", "a.y2")),
        _turn(_bearing(*_ARM["a"]), _bearing(*_ARM["b"])),
        _turn(_bearing(*_ARM["a"]), _bearing("b.x2", "b.y2"))),
    "(q.b0 < q.full) <> (q.b1 < q.full)")

_AT_TOUCH = f"""CASE
  WHEN t IS NULL THEN NULL
  WHEN a.g = b.g AND {_ADJACENT} THEN NULL
  WHEN a.g = b.g THEN {_HIT.format(_RING_TOUCH, 't.x', 't.y')}
  WHEN {_ENDS_HERE} THEN NULL
  WHEN {_ARMS_CROSS} THEN {_HIT.format(_CROSSING, 't.x', 't.y')}
  ELSE {_HIT.format(_RINGS_MEET, 't.x', 't.y')} END"""

HIT = f"""CASE
  WHEN o.b1 = 0 AND o.b2 = 0 AND (least(a.xh, b.xh) > greatest(a.xl, b.xl) OR least(a.yh, b.yh) > greatest(a.yl, b.yl))
    THEN {_HIT.format(_CROSSING, 'greatest(a.xl, b.xl)', 'greatest(a.yl, b.yl)')}
  WHEN sign(o.b1) * sign(o.b2) < 0 AND sign(o.a1) * sign(o.a2) < 0
    THEN {_HIT.format(_CROSSING, 'a.x1 + (a.x2 - a.x1) * (o.a1 / (o.a1 - o.a2))',
                      'a.y1 + (a.y2 - a.y1) * (o.a1 / (o.a1 - o.a2))')}
  WHEN o.b1 <> 0 AND o.b2 <> 0 AND o.a1 <> 0 AND o.a2 <> 0 THEN NULL
  ELSE {let('t', _TOUCH_POINT, _AT_TOUCH)} END"""

_HITS = f"""filter(flatten(transform(edges, (a, k) ->
  transform(filter(slice(edges, k + 2, size(edges)), b -> {BOXES_MEET}),
            b -> {let('o', SIDES, HIT)}))), h -> h IS NOT NULL)"""


# --- points and rings ---------------------------------------------------------------------------

def on_outline(v: str, ring: str) -> str:
    return f"exists({ring}, e -> {_side('e', v + '.x1', v + '.y1')} = 0 AND {_within('e', v + '.x1', v + '.y1')})"


def ray_hits(v: str) -> str:
    """Edge ``e`` lies to the right of the start of ``v``."""
    return (f"(e.y1 <= {v}.y1) <> (e.y2 <= {v}.y1) AND "
            f"{v}.x1 < e.x1 + (e.x2 - e.x1) * (({v}.y1 - e.y1) / (e.y2 - e.y1))")


def _odd(v: str, ring: str) -> str:
    return f"size(filter({ring}, e -> {ray_hits(v)})) % 2 = 1"


def _first_vertex(where: str) -> str:
    """The smallest vertex ``v`` that meets a condition, null when none does; both paths name this one.

    Every vertex is tested: those of rings of different parts may touch any number of times.
    """
    return (f"array_min(transform(filter(edges, v -> {where}), "
            "v -> named_struct('x1', v.x1, 'y1', v.y1)))")


_SHELL = "filter(edges, s -> s.part = v.part AND s.ring = 0)"
_OUTSIDE = _first_vertex(f"v.ring > 0 AND NOT ({on_outline('v', _SHELL)}) AND NOT ({_odd('v', _SHELL)})")
_OTHER_HOLE = "filter(edges, s -> s.part = v.part AND s.g = h.g)"
_IN_HOLE = _first_vertex(
    "v.ring > 0 AND exists(filter(points, h -> h.ring > 0 AND h.part = v.part AND h.g <> v.g), "
    f"h -> {_odd('v', _OTHER_HOLE)} AND NOT ({on_outline('v', _OTHER_HOLE)}))")
_OTHER_PART = "filter(edges, s -> s.part = h.part)"
_IN_SHELL = _first_vertex(
    "v.ring = 0 AND exists(filter(points, h -> h.ring = 0 AND h.part <> v.part), "
    f"h -> {_odd('v', _OTHER_PART)} AND NOT ({on_outline('v', _OTHER_PART)}))")

_MEETINGS = f"filter(hits, h -> h.code = {_RINGS_MEET} AND h.pa = h.pb)"
# Rings and the points where they meet, as links of a graph. Links whose ring or
# point has no other link are taken away again and again: what is left are cycles.
_LINKS = f"""array_distinct(flatten(transform({_MEETINGS}, h -> array(
  named_struct('p', h.pa, 'g', h.ga, 'x', h.x, 'y', h.y), named_struct('p', h.pa, 'g', h.gb, 'x', h.x, 'y', h.y)))))"""
_ON_CYCLES = let("links", _LINKS, """aggregate(sequence(1, greatest(1, size(links))), links, (s, i) -> CASE
  WHEN size(s) < 4 THEN slice(s, 1, 0) ELSE filter(s, l ->
    exists(s, k -> k.g = l.g AND (k.x <> l.x OR k.y <> l.y)) AND exists(s, k -> k.x = l.x AND k.y = l.y AND k.p = l.p AND k.g <> l.g)) END)""")


# All values a verdict needs are bound inside one expression: as columns they
# would be copied into every filter the optimizer pushes down.
_FEW = f"get(filter(points, d -> size(d.x) < CASE WHEN {_AREAL} THEN 4 ELSE 2 END), 0)"
_RING_VERDICT = let("c", f"array_min(filter(hits, h -> h.code < {_RINGS_MEET}))", f"""CASE
  WHEN c.code = {_CROSSING} THEN {_at(SELF_INTERSECTION, 'c.x', 'c.y')}
  WHEN c.code = {_RING_TOUCH} THEN {_at(RING_SELF_INTERSECTION, 'c.x', 'c.y')}
  WHEN size(points) > 1 THEN coalesce(
    {let('w', _OUTSIDE, _at(HOLE_OUTSIDE, 'w.x1', 'w.y1'))},
    {let('w', _IN_HOLE, _at(NESTED_HOLES, 'w.x1', 'w.y1'))},
    {let('w', _IN_SHELL, _at(NESTED_SHELLS, 'w.x1', 'w.y1'))},
    {let('w', f"array_min(transform({_ON_CYCLES}, h -> named_struct('x', h.x, 'y', h.y)))", _at(DISCONNECTED, 'w.x', 'w.y'))})
  END""")
_AREAL_VERDICT = let("edges", _EDGES, let("hits", _HITS, _RING_VERDICT))


def check_in_row(features: DataFrame, max_edges: int) -> DataFrame:
    """Add ``error``: why the geometry is empty or invalid, null when it is neither.

    Polygons with more than ``max_edges`` edges are only checked for points
    here; see :func:`check_large`.
    """
    verdict = let("points", _POINTS, let("few", _FEW, f"""CASE
      WHEN few IS NOT NULL THEN {_at(TOO_FEW_POINTS, 'few.x[0]', 'few.y[0]')}
      WHEN {_AREAL} AND n_edges <= {max_edges} THEN {_AREAL_VERDICT} END"""))
    return features.withColumn("error", F.expr(f"""CASE
      WHEN malformed THEN NULL
      WHEN n_edges = 0 THEN '{EMPTY}'
      WHEN {_AREAL} OR {_LINEAR} THEN {verdict} END"""))


# --- large polygons -----------------------------------------------------------------------------

# A grid cell may hold this many edges before it is divided again.
MAX_EDGES_IN_CELL = 48
SUBDIVISION = 16
MAX_DIVISIONS = 12
#: A vertex where more edges end is a hub: they are compared by their bearings, not in pairs.
HUB = 16

#: Columns and rows of the grid that a cell belongs to, and its place there.
_CELL = ["area_id", "pos", "sx", "sy", "cx", "cy"]
_FAULTS = {ring_nesting.OUT: _OUT, ring_nesting.IN_HOLE: _IN_OTHER_HOLE, ring_nesting.IN_SHELL: _IN_OTHER_SHELL,
           ring_nesting.APART: _APART}


def large_ring_edges(features: DataFrame) -> DataFrame:
    """Edges of large polygons with the box of their feature and the side of its grid."""
    pointed = features.withColumn("points", F.expr(_POINTS))
    boxed = pointed.select(
        "area_id", "pos", F.expr(_EDGES).alias("edges"),
        F.expr("array_min(flatten(rings.lon))").alias("x0"), F.expr("array_min(flatten(rings.lat))").alias("y0"),
        F.expr("array_max(flatten(rings.lon))").alias("xe"), F.expr("array_max(flatten(rings.lat))").alias("ye"))
    sized = boxed.select(
        "area_id", "pos", "edges", "x0", "y0",
        *[F.expr("greatest(1, cast(ceil(sqrt(size(edges))) AS BIGINT))").alias(c) for c in ("sx", "sy")],
        F.expr("greatest((xe - x0), 1e-12D)").alias("width"),
        F.expr("greatest((ye - y0), 1e-12D)").alias("depth"))
    return sized.select("area_id", "pos", "x0", "y0", "sx", "sy", "width", "depth",
                        F.explode_outer("edges").alias("e")).filter("e IS NOT NULL")


def hub_arms(edges: DataFrame) -> DataFrame:
    """(area_id, pos, x, y, e) for each edge that ends at a hub."""
    ends = edges.select("area_id", "pos", "e", F.explode(F.expr("array(struct(e.x1 AS x, e.y1 AS y), struct(e.x2 AS x, e.y2 AS y))")).alias("p"))
    hubs = ends.groupBy("area_id", "pos", "p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).drop("n")
    # hubs are at most one in HUB / 2 vertices
    return ends.join(hubs, ["area_id", "pos", "p"]).select("area_id", "pos", "p.x", "p.y", "e")


def _with_hubs(edges: DataFrame, arms: DataFrame) -> DataFrame:
    """Edges with ``hub``, a hub that they end at: two edges of one hub meet nowhere else."""
    marked = arms.groupBy("area_id", "pos", F.col("e.g").alias("g"), F.col("e.i").alias("i")).agg(
        F.min(F.struct("x", "y")).alias("hub"))
    keyed = edges.withColumn("g", F.col("e.g")).withColumn("i", F.col("e.i"))
    return keyed.join(marked, ["area_id", "pos", "g", "i"], "left").drop("g", "i")


def _over_grid(edges: DataFrame, within: bool = False) -> DataFrame:
    """Cells of the feature's grid that an edge passes, a little widened: by a share of a cell and by some last places.

    ``within``: only the ``fx`` by ``fy`` cells inside the coarser cell (ox, oy),
    so that a long edge is not laid over the whole finer grid.
    """
    wider = "least(0.5D, 1e-6D + 1e-14D * sx * (abs(x0) + width) / width)"
    higher = "least(0.5D, 1e-6D + 1e-14D * sy * (abs(y0) + depth) / depth)"

    def cells(first: str, last: str, coarse: str, fine: str):
        if within:
            first, last = f"greatest({first}, {coarse} * {fine})", f"least({last}, {coarse} * {fine} + {fine} - 1)"
        return F.explode_outer(F.expr(let("s", f"named_struct('a', {first}, 'b', {last})", "CASE WHEN s.a <= s.b THEN sequence(s.a, s.b) END")))

    def column(value: str, by: str) -> str:
        return f"cast(floor(({value} - x0) / width * sx {by}) AS BIGINT)"

    def row(value: str, by: str) -> str:
        return f"cast(floor(({value} - y0) / depth * sy {by}) AS BIGINT)"

    columns = edges.withColumn("cx", cells(
        column("e.xl", f"- {wider}"), column("e.xh", f"+ {wider}"), "ox", "fx")).filter("cx IS NOT NULL")
    left, right = "(x0 + cx * width / sx)", "(x0 + (cx + 1) * width / sx)"
    at = "e.y1 + (e.y2 - e.y1) * (({v} - e.x1) / (e.x2 - e.x1))"
    steep = "e.x1 = e.x2"
    west, east = f"least(e.xh, greatest(e.xl, {left}))", f"greatest(e.xl, least(e.xh, {right}))"
    cut = columns.select(
        "*",
        F.expr(f"CASE WHEN {steep} THEN e.y1 ELSE {at.format(v=west)} END").alias("ya"),
        F.expr(f"CASE WHEN {steep} THEN e.y2 ELSE {at.format(v=east)} END").alias("yb"))
    return cut.withColumn("cy", cells(
        row("least(ya, yb)", f"- {higher}"), row("greatest(ya, yb)", f"+ {higher}"), "oy", "fy")).filter(
        "cy IS NOT NULL")


def _divide(cells: DataFrame, save) -> DataFrame:
    """Divide crowded cells until none is: along the axis on which their edges are shorter, so few edges repeat.

    Edges that end at one hub do not crowd each other.
    """
    settled = []
    # how much of a cell's height and width the edge's way through it takes
    tall = ("greatest(0D, least(greatest(ya, yb), y0 + (cy + 1) * depth / sy) - greatest(least(ya, yb), y0 + cy * depth / sy))")
    wide = (f"CASE WHEN e.y1 = e.y2 THEN least(e.xh, x0 + (cx + 1) * width / sx) - greatest(e.xl, x0 + cx * width / sx) "
            f"ELSE {tall} * abs((e.x2 - e.x1) / (e.y2 - e.y1)) END")
    for division in range(MAX_DIVISIONS):
        cells = save(cells, f"validity-cells-{division}")
        crowded = cells.groupBy(*_CELL).agg(
            F.count_if(F.col("hub").isNull()).alias("free"), F.count(F.lit(1)).alias("all"), F.min("hub").alias("a"), F.max("hub").alias("b"),
            (F.sum(F.expr(f"{wide} / (width / sx)")) <= F.sum(F.expr(f"{tall} / (depth / sy)"))).alias("across")).filter(
            (F.col("free") > MAX_EDGES_IN_CELL) | ((F.col("a") != F.col("b")) & (F.col("all") > MAX_EDGES_IN_CELL))).select(*_CELL, "across")
        crowded = save(crowded, f"validity-crowded-{division}")
        if crowded.isEmpty() or division == MAX_DIVISIONS - 1:
            settled.append(cells)
            break
        settled.append(cells.join(crowded, _CELL, "left_anti"))
        finer = cells.drop("ya", "yb").join(crowded, _CELL).withColumnsRenamed({"cx": "ox", "cy": "oy"}).withColumn(
            "fx", F.when(F.col("across"), SUBDIVISION).otherwise(1).cast("long")).withColumn(
            "fy", F.when(F.col("across"), 1).otherwise(SUBDIVISION).cast("long")).withColumn(
            "sx", F.col("sx") * F.col("fx")).withColumn("sy", F.col("sy") * F.col("fy"))
        cells = _over_grid(finer, within=True).select(*cells.columns)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def edge_pairs(cells: DataFrame) -> DataFrame:
    """(area_id, pos, a, b) of the edges that share a cell and whose boxes meet, but for those at one hub."""
    def side(name: str, which: str) -> DataFrame:
        return cells.filter(which).select(*_CELL, F.col("e").alias(name), F.col("hub").alias(f"hub_{name}"))

    free, bound, several = "hub IS NULL", "hub IS NOT NULL", "several"
    loose = side("a", free).join(side("b", free), _CELL).filter("a.g < b.g OR (a.g = b.g AND a.i < b.i)")
    mixed = side("a", free).join(side("b", bound), _CELL)
    apart = cells.filter(bound).groupBy(*_CELL).agg((F.min("hub") != F.max("hub")).alias(several)).filter(several).drop(several)
    two = side("a", bound).join(apart, _CELL).join(side("b", bound), _CELL).filter(
        "hub_a <> hub_b AND (a.g < b.g OR (a.g = b.g AND a.i < b.i))")
    pairs = loose.unionByName(mixed).unionByName(two).filter(BOXES_MEET)
    first = "a.g < b.g OR (a.g = b.g AND a.i < b.i)"
    return pairs.select("area_id", "pos", F.expr(f"CASE WHEN {first} THEN a ELSE b END").alias("a"),
                        F.expr(f"CASE WHEN {first} THEN b ELSE a END").alias("b"))


def _judge_hub(arms: pd.DataFrame) -> pd.DataFrame:
    """What the edges at one hub do there: rings that pass it twice, edges along each other, rings that cross; else its rings."""
    area_id, pos, x, y = arms.iloc[0][["area_id", "pos", "x", "y"]]
    out = []
    dx = np.where((arms.x1 == x) & (arms.y1 == y), arms.x2, arms.x1) - x
    dy = np.where((arms.x1 == x) & (arms.y1 == y), arms.y2, arms.y1) - y
    turn = np.lexsort((arms.g, np.arctan2(dy, dx)))
    g, dx, dy = arms.g.to_numpy()[turn], dx[turn], dy[turn]
    low, left = arms.yl.to_numpy()[turn], arms.xl.to_numpy()[turn]
    along = np.flatnonzero((dx * np.roll(dy, -1) == dy * np.roll(dx, -1)) & (dx * np.roll(dx, -1) + dy * np.roll(dy, -1) > 0))
    for k in along:
        n = (k + 1) % len(g)
        out.append((_CROSSING, max(left[k], left[n]), max(low[k], low[n])))
    rings, times = np.unique(g, return_counts=True)
    if (times > 2).any():
        out.append((_RING_TOUCH, x, y))
    waiting: list[int] = []
    for ring in g:
        if waiting and waiting[-1] == ring:
            waiting.pop()
        else:
            waiting.append(ring)
    if waiting and not out:
        out.append((_CROSSING, x, y))
    rows = [(code, px, py, -1) for code, px, py in out] or [(_RINGS_MEET, x, y, r) for r in rings]
    return pd.DataFrame([(area_id, pos, *r) for r in rows], columns=["area_id", "pos", "code", "x", "y", "g"])


def _nesting_faults(edges: pd.DataFrame, touches: pd.DataFrame) -> pd.DataFrame:
    """Faults of one feature's rings; its edges fit in a task, as they come from one row."""
    columns = ["area_id", "pos", "rank", "x", "y"]
    if edges.empty:
        return pd.DataFrame([], columns=columns)
    found = ring_nesting.faults({c: edges[c].to_numpy() for c in ("g", "part", "ring", "x1", "y1", "x2", "y2")},
                                list(zip(touches.g.tolist(), touches.x.tolist(), touches.y.tolist())))
    return pd.DataFrame([(edges.area_id.iloc[0], edges.pos.iloc[0], _FAULTS[kind], x, y) for kind, x, y in found], columns=columns)


for _module in (sys.modules[__name__], ring_nesting):  # they travel inside the closures: executors need no copy
    cloudpickle.register_pickle_by_value(_module)


def check_large(features: DataFrame, save) -> DataFrame:
    """(area_id, pos, error) of the invalid ones among large polygons.

    Edges meet only in grid cells, and cells with many edges are divided again;
    edges that end at one vertex are ordered by their bearings, so no group is
    compared all against all. Rings of features without a crossing are nested by
    a sweep. ``save(df, name)`` stores an intermediate result and returns it.
    """
    edges = save(large_ring_edges(features), "validity-edges")
    arms = save(hub_arms(edges), "validity-hubs")
    cells = _divide(_over_grid(_with_hubs(edges, arms)), save)
    hits = edge_pairs(cells).withColumn("o", F.expr(SIDES)).select("area_id", "pos", F.expr(HIT).alias("h")).filter(
        "h IS NOT NULL")
    hits = save(hits, "validity-hits")
    hubs = save(arms.select("area_id", "pos", "x", "y", "e.g", "e.x1", "e.y1", "e.x2", "e.y2", "e.xl", "e.yl").groupBy(
        "area_id", "pos", "x", "y").applyInPandas(
        _judge_hub, features.select("area_id", "pos").schema.add("code", "integer").add("x", "double").add("y", "double").add("g", "integer")), "validity-hub-hits")
    coded = hits.select("area_id", "pos", "h.code", "h.x", "h.y").unionByName(hubs.select("area_id", "pos", "code", "x", "y"))
    crossing = coded.filter(f"code < {_RINGS_MEET}").groupBy("area_id", "pos").agg(F.min(F.struct("code", "x", "y")).alias("h")).select(
        "area_id", "pos", F.col("h.code").alias("rank"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))
    crossing = save(crossing, "validity-crossing")
    touches = hits.filter(f"h.code = {_RINGS_MEET}").select("area_id", "pos", "h.x", "h.y", F.explode(F.array("h.ga", "h.gb")).alias("g"))
    touches = touches.unionByName(hubs.filter(f"code = {_RINGS_MEET}").select("area_id", "pos", "x", "y", "g")).distinct()
    several = edges.filter("e.g > 0").select("area_id", "pos").distinct().join(crossing, ["area_id", "pos"], "left_anti")
    flat = edges.join(several, ["area_id", "pos"], "left_semi").select(
        "area_id", "pos", *[f"e.{c}" for c in ("g", "part", "ring", "x1", "y1", "x2", "y2")])
    misplaced = flat.groupBy("area_id", "pos").cogroup(touches.groupBy("area_id", "pos")).applyInPandas(
        _nesting_faults, crossing.schema)
    found = crossing.unionByName(misplaced)
    texts = " ".join(f"WHEN {rank} THEN {_at(text, 'w.x', 'w.y')}" for rank, text in _RANKED.items())
    return found.groupBy("area_id", "pos").agg(F.min(F.struct("rank", "x", "y")).alias("w")).select(
        "area_id", "pos", F.expr(f"CASE w.rank {texts} END").alias("error"))
