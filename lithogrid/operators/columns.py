"""Spans of small features by a moving edge table, over Arrow batches.

Each edge, or capsule of a line, is laid over the grid columns that it reaches
and no others; the crossings of a column are then sorted and paired, ranges that
overlap are merged. Features are taken together until their edges reach ``CUTS``
columns, and one that reaches more is cut into runs of columns, so memory does
not grow with a feature's width. The formulas are those of ``functions.planar``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places where an edge meets a column that are held at once.
CUTS = 1 << 20
_SIDES = (1, 2, 3, 4)
_QUAD = [f"{v}{k}" for k in _SIDES for v in "abxz"]
_SHIFT, _WIDE = 1 << 40, 1 << 41


def first_cell(position: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.ceil(position / r - 0.5).astype(np.int64)


def last_cell(position: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.floor(position / r - 0.5).astype(np.int64)


class Rows:
    """Features of a batch: their edges, flat, and their areas."""

    def __init__(self, batch: pa.RecordBatch):
        edges, quad = batch.column("edges"), batch.column("quad")
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.r, self.first, self.last = number("r"), number("first_column").astype(np.int64), number("last_column").astype(np.int64)
        self.radius = number("radius").astype(np.float64)
        sizes = edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(batch)), sizes)
        flat = edges.flatten()
        self.x1, self.z1, self.x2, self.z2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "z1", "x2", "z2"))
        self.quad = {c: quad.field(c).to_numpy(zero_copy_only=False) for c in _QUAD}

    def reach(self, row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell of the area on the vertical lines at ``x``."""
        bottom, top = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in _SIDES:
                a, b, x0, z0 = (self.quad[f"{v}{k}"][row] for v in "abxz")
                z = z0 - a * (x - x0) / b
                bottom = np.where(b > 0, np.maximum(bottom, z), bottom)
                top = np.where(b < 0, np.minimum(top, z), top)
        return first_cell(bottom, self.r[row]), last_cell(top, self.r[row])


def _over(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and column for every column from first to last of each element."""
    n = np.maximum(last - first + 1, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _finish(rows: Rows, row: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, x, z0, z1) of the cells between two heights, cut to the area and without overlaps."""
    r = rows.r[row]
    bottom, top = rows.reach(row, (c + 0.5) * r)
    z0, z1 = np.maximum(first_cell(low, r), bottom), np.minimum(last_cell(high, r), top)
    kept = np.flatnonzero(z0 <= z1)
    order = kept[np.lexsort((z1[kept], z0[kept], c[kept], row[kept]))]
    row, c, z0, z1 = row[order], c[order], z0[order], z1[order]
    if not len(row):
        return row, c, z0, z1
    group = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (c[1:] != c[:-1])]))
    reached = np.maximum.accumulate(group * _WIDE + z1 + _SHIFT) - group * _WIDE - _SHIFT
    same = np.concatenate([[False], group[1:] == group[:-1]])
    z0 = np.where(same, np.maximum(z0, np.concatenate([[0], reached[:-1]]) + 1), z0)
    kept = z0 <= z1
    return row[kept], c[kept], z0[kept], z1[kept]


def polygon_cuts(rows: Rows):
    """(edge, first, last column) of polygon edges, and what makes heights of them."""
    r = rows.r[rows.row]
    least, most = np.full(len(rows.r), np.inf), np.full(len(rows.r), -np.inf)
    low, high = np.minimum(rows.x1, rows.x2), np.maximum(rows.x1, rows.x2)
    np.minimum.at(least, rows.row, low)
    np.maximum.at(most, rows.row, high)
    has = least <= most
    safe = lambda v: np.where(has, v, 0.0)
    begin = np.maximum(first_cell(safe(least), rows.r), rows.first)
    end = np.where(has, np.minimum(last_cell(safe(most), rows.r), rows.last), begin - 1)
    first = np.maximum(first_cell(low, r) - 1, begin[rows.row])
    last = np.minimum(last_cell(high, r) + 1, end[rows.row])

    def heights(at: np.ndarray, c: np.ndarray):
        row = rows.row[at]
        x = (c + 0.5) * rows.r[row]
        crosses = (rows.x1[at] <= x) != (rows.x2[at] <= x)
        rests = high[at] == x
        n, k = at[crosses], c[crosses]
        z = rows.z1[n] + (rows.z2[n] - rows.z1[n]) * ((x[crosses] - rows.x1[n]) / (rows.x2[n] - rows.x1[n]))
        order = np.lexsort((z, k, rows.row[n]))
        own, k, z = rows.row[n][order], k[order], z[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (k[1:] != k[:-1])]) if len(own) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        below = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:]) if len(own) else np.zeros(0, np.int64)
        m, km, xm = at[rests], c[rests], x[rests]
        upright = rows.x1[m] == rows.x2[m]
        end_z = np.where(rows.x1[m] == xm, rows.z1[m], rows.z2[m])
        rest_low = np.where(upright, np.minimum(rows.z1[m], rows.z2[m]), end_z)
        rest_high = np.where(upright, np.maximum(rows.z1[m], rows.z2[m]), end_z)
        return (np.concatenate([own[below], rows.row[m]]), np.concatenate([k[below], km]),
                np.concatenate([z[below], rest_low]), np.concatenate([z[below + 1], rest_high]))

    return rows.row, first, last, heights


def capsule_cuts(rows: Rows):
    """The same for the capsules around the edges of lines and points, cut to the area first."""
    row = rows.row
    t0, t1, out = np.zeros(len(row)), np.ones(len(row)), np.zeros(len(row), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in _SIDES:
            a, b, x0, z0 = (rows.quad[f"{v}{k}"][row] for v in "abxz")
            f, g = b * (rows.z1 - z0) + a * (rows.x1 - x0), b * (rows.z2 - z0) + a * (rows.x2 - x0)
            out |= (f < 0) & (g < 0)
            t0 = np.where(f < 0, np.maximum(t0, f / (f - g)), t0)
            t1 = np.where(g < 0, np.minimum(t1, f / (f - g)), t1)
    met = np.flatnonzero(~out & (t0 <= t1))
    row, t0, t1 = row[met], t0[met], t1[met]
    x1, z1, x2, z2 = (v[met] for v in (rows.x1, rows.z1, rows.x2, rows.z2))
    ax, az, bx, bz = x1 + t0 * (x2 - x1), z1 + t0 * (z2 - z1), x1 + t1 * (x2 - x1), z1 + t1 * (z2 - z1)
    rising = ax <= bx
    px, pz = np.minimum(ax, bx), np.where(rising, az, bz)
    dx, dz = np.abs(bx - ax), np.where(rising, bz - az, az - bz)
    len2 = (bx - ax) * (bx - ax) + (bz - az) * (bz - az)
    radius, r = rows.radius[row], rows.r[row]
    west, east, qx, qz = px - radius, px + dx + radius, px + dx, pz + dz
    long = np.sqrt(len2)
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.where(len2 > 0, radius * dz / long, 0.0)
        slope = np.where(dx > 0, dz / dx, 0.0)
        above = np.where(dx > 0, radius * long / dx, np.where(len2 > 0, np.maximum(dz, 0.0), radius))
        below = np.where(dx > 0, -radius * long / dx, np.where(len2 > 0, np.minimum(dz, 0.0), -radius))
    first = np.maximum(first_cell(west, r) - 1, rows.first[row])
    last = np.minimum(last_cell(east, r) + 1, rows.last[row])

    def heights(at: np.ndarray, c: np.ndarray):
        x = (c + 0.5) * r[at]
        inside = (x >= west[at]) & (x <= east[at])
        at, c, x = at[inside], c[inside], x[inside]

        def outline(sign: int, side: np.ndarray) -> np.ndarray:
            def disc(ex: np.ndarray, ez: np.ndarray) -> np.ndarray:
                return ez[at] + sign * np.sqrt(np.maximum(0.0, radius[at] * radius[at] - (x - ex[at]) * (x - ex[at])))

            return np.where(x > qx[at] - sign * shift[at], disc(qx, qz), np.where(
                x < px[at] - sign * shift[at], disc(px, pz), pz[at] + (x - px[at]) * slope[at] + side[at]))

        return row[at], c, outline(-1, below), outline(1, above)

    return row, first, last, heights


def _blocks(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Elements with their columns, few enough at a time; all elements of a feature's column come together."""
    cuts = np.maximum(last - first + 1, 0)
    live = np.flatnonzero(cuts > 0)
    if not len(live):
        return
    own, cuts = row[live], cuts[live]  # rows ascend
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    total = np.add.reduceat(cuts, new)
    ends = np.append(new[1:], len(live))
    start = 0
    while start < len(new):
        stop, held = start + 1, total[start]
        while stop < len(new) and held + total[stop] <= CUTS:
            held += total[stop]
            stop += 1
        some = live[new[start]:ends[stop - 1]]
        if held <= CUTS:
            yield some, first[some], last[some]
        else:  # one feature over many columns
            step = max(1, CUTS // len(some))
            for low in range(int(first[some].min()), int(last[some].max()) + 1, step):
                yield some, np.maximum(first[some], low), np.minimum(last[some], low + step - 1)
        start = stop


def _counts(cuts: Callable, keep: list[str], wanted: int):
    """Cells in every so-manieth column of each feature; all of them where it reaches no more than ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = Rows(batch), len(batch)
            row, first, last, heights = cuts(rows)
            live = first <= last
            low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
            np.minimum.at(low, row[live], first[live])
            np.maximum.at(high, row[live], last[live])
            stride = np.ones(size, np.int64)
            met = low <= high
            stride[met] = (high[met] - low[met]) // wanted + 1
            own = stride[row]
            cells = np.zeros(size)
            for some, begin, end in _blocks(row, -(-first // own), last // own):
                at, c = _over(begin, end)
                owner, _, z0, z1 = _finish(rows, *heights(some[at], c * own[some[at]]))
                cells += np.bincount(owner, z1 - z0 + 1.0, size)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(cells), pa.array(stride == 1)], [*keep, "cells", "exact"])

    return run


def _spans(cuts: Callable, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch)
            row, first, last, heights = cuts(rows)
            for some, low, high in _blocks(row, first, last):
                at, c = _over(low, high)
                owner, x, z0, z1 = _finish(rows, *heights(some[at], c))
                if len(owner):
                    taken = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(taken) for k in keep), pa.array(x), pa.array(z0), pa.array(z1)], [*keep, "x", "z0", "z1"])

    return run


# Ship this module inside the task closure: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ready(features: DataFrame, keep: list[str], thick: bool) -> DataFrame:
    radius = (F.col("width") / 2) if thick else F.lit(0.0)
    edges = F.transform("edges", lambda e: F.struct(*[e[c].alias(c) for c in ("x1", "z1", "x2", "z2")]))
    return features.select(*keep, F.col("voxel_size_m").alias("r"), "quad", F.col("first_column").cast("long"),
                           F.col("last_column").cast("long"), radius.cast("double").alias("radius"), edges.alias("edges"))


def spans(features: DataFrame, keep: list[str], thick: bool) -> DataFrame:
    """Spans of features with ``edges``; ``keep`` names the columns to carry along."""
    schema = features.select(*keep).schema
    for name in ("x", "z0", "z1"):
        schema = schema.add(name, "long")
    return _ready(features, keep, thick).mapInArrow(_spans(capsule_cuts if thick else polygon_cuts, keep), schema)


def counted(features: DataFrame, keep: list[str], thick: bool, wanted: int) -> DataFrame:
    """``cells`` of each feature in at most ``wanted`` of its columns, evenly spaced; ``exact`` if those are all.

    The count over some columns is never more than the count over all.
    """
    schema = features.select(*keep).schema.add("cells", "double").add("exact", "boolean")
    return _ready(features, keep, thick).mapInArrow(_counts(capsule_cuts if thick else polygon_cuts, keep, wanted), schema)
