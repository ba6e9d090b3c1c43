"""How the rings of one polygon lie in each other, once no two of them cross.

A sweep upwards keeps the edges at the current height in order from west to
east. Each ring asks once, at a vertex that touches no other ring, for the
nearest edge of another ring to its west: it lies in that edge's ring or in
what that ring lies in. Rings and the points where they touch form a graph; a
cycle in it cuts the interior. Both are near linear in the number of edges.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from functools import cmp_to_key

import numpy as np

OUT, IN_HOLE, IN_SHELL, APART = "out", "in hole", "in shell", "apart"


def on_cycles(links: list[tuple]) -> set:
    """Points left when rings and points with one link are taken away again and again."""
    at_ring, at_point = defaultdict(set), defaultdict(set)
    for ring, point in links:
        at_ring[ring].add(point)
        at_point[point].add(ring)
    waiting = deque([(True, r) for r, ps in at_ring.items() if len(ps) < 2] + [(False, p) for p, rs in at_point.items() if len(rs) < 2])
    while waiting:
        is_ring, node = waiting.popleft()
        own, other = (at_ring, at_point) if is_ring else (at_point, at_ring)
        for end in own.pop(node, ()):
            other[end].discard(node)
            if len(other[end]) == 1:
                waiting.append((not is_ring, end))
    return {p for p, rs in at_point.items() if len(rs) > 1}


def parents(g: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, touching: set) -> dict[int, int | None]:
    """The ring that each ring lies in directly. ``touching``: (ring, x, y) of the vertices on other rings.

    A ring asks at its lowest vertex that touches no other ring, else in the middle of an edge.
    """
    area, first = defaultdict(float), {}
    for ring, a, b, c, d in zip(*(v.tolist() for v in (g, x1, y1, x2, y2))):
        x0, y0 = first.setdefault(ring, (a, b))
        area[ring] += (a - x0) * (d - y0) - (c - x0) * (b - y0)
    probes: dict[int, tuple[float, float]] = {}
    for ring, a, b in zip(g.tolist(), x1.tolist(), y1.tolist()):
        if (ring, a, b) not in touching and (ring not in probes or (b, a) < probes[ring]):
            probes[ring] = (b, a)
    if len(probes) < len(first):  # all vertices touch other rings: the middle of an edge
        for ring, a, b, c, d in zip(*(v.tolist() for v in (g, x1, y1, x2, y2))):
            middle = ((b + d) / 2, (a + c) / 2)
            if ring not in probes and b != d and (ring, *middle[::-1]) not in touching:
                probes[ring] = middle
    flat = y1 == y2
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    edges = list(zip(g.tolist(), np.where(y1 < y2, x1, x2).tolist(), low.tolist(), np.where(y1 < y2, x2, x1).tolist(), high.tolist(),
                     (y1 < y2).tolist()))

    def east_at(edge: tuple, y: float) -> float:
        _, xl, yl, xh, yh, _ = edge
        return xl if y == yl else xh if y == yh else xl + (xh - xl) * ((y - yl) / (yh - yl))

    def order(a: tuple, b: tuple) -> int:
        """West to east over the heights that both edges have."""
        bottom, top = max(a[2], b[2]), min(a[4], b[4])
        for y in ((bottom + top) / 2, top, bottom):
            apart = east_at(a, y) - east_at(b, y)
            if apart:
                return -1 if apart < 0 else 1
        return 0

    as_key = cmp_to_key(order)
    # at one height: edges that end go first, then those that start, then the probes
    events = [(h, 0, n) for n, h in enumerate(high.tolist()) if not flat[n]]
    events += [(h, 1, n) for n, h in enumerate(low.tolist()) if not flat[n]]
    events += [(y, 2, ring) for ring, (y, _) in probes.items()]
    status: list = []  # keys of the edges at this height
    held: list[int] = []
    west: dict[int, tuple | None] = {}
    for y, what, n in sorted(events):
        if what == 2:
            at, x = len(held), probes[n][1]
            lo, hi = 0, len(held)
            while lo < hi:  # edges before ``lo`` lie west of the probe
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if east_at(edges[held[mid]], y) < x else (lo, mid)
            at = lo - 1
            while at >= 0 and edges[held[at]][0] == n:
                at -= 1
            west[n] = edges[held[at]] if at >= 0 else None
            continue
        key = as_key(edges[n])
        at = bisect_left(status, key)
        if what == 1:
            status.insert(at, key)
            held.insert(at, n)
        else:
            while at < len(held) and held[at] != n:
                at += 1
            if at == len(held):
                at = held.index(n)
            del status[at], held[at]
    found: dict[int, int | None] = {}

    def inside(edge: tuple) -> bool:
        """Whether east of an edge is inside its ring: edges of rings that turn left run down their west side."""
        return edge[5] == (area[edge[0]] < 0)

    for ring in west:
        passed, now = [], ring
        while now not in found and now not in passed:
            edge = west.get(now)
            if edge is None or inside(edge):
                found[now] = None if edge is None else edge[0]
                break
            passed.append(now)
            now = edge[0]
        up = found.get(now)
        for other in passed:
            found[other] = up
    return found


def faults(edges: dict[str, np.ndarray], touches: list[tuple]) -> list[tuple[str, float, float]]:
    """(kind, x, y) of what is wrong, at its smallest point.

    ``edges``: arrays g, part, ring, x1, y1, x2, y2, g numbering all rings and
    ring those of a part, the shell first. ``touches``: (g, x, y) of each ring at each point where rings meet.
    """
    g, part, ring = (edges[c] for c in ("g", "part", "ring"))
    x1, y1 = edges["x1"], edges["y1"]
    part_of, ring_of = dict(zip(g.tolist(), part.tolist())), dict(zip(g.tolist(), ring.tolist()))
    shell_of = {part_of[r]: r for r, k in ring_of.items() if k == 0}
    at_point = defaultdict(set)
    for r, x, y in touches:
        at_point[x, y].add(r)
    up = parents(g, x1, y1, edges["x2"], edges["y2"], {(r, x, y) for r, x, y in touches if len(at_point[x, y]) > 1})
    vertices = defaultdict(list)
    for r, x, y in zip(g.tolist(), x1.tolist(), y1.tolist()):
        vertices[r].append((x, y))

    def around(r: int) -> list[int]:
        chain = []
        while (r := up.get(r)) is not None and len(chain) < len(up):
            chain.append(r)
        return chain

    found: dict[str, tuple[float, float]] = {}

    def report(kind: str, r: int, others: set[int]) -> None:
        points = [p for p in vertices[r] if not at_point.get(p, frozenset()) & others]
        if points:
            found[kind] = min(found.get(kind, (np.inf, np.inf)), min(points))

    for r in up:
        chain, own = around(r), part_of[r]
        if ring_of[r] > 0:
            if shell_of.get(own) not in chain:
                report(OUT, r, {shell_of.get(own)})
            for other in chain:
                if part_of[other] == own and ring_of[other] > 0:
                    report(IN_HOLE, r, {other})
        else:
            counts = defaultdict(int)
            for other in chain:
                counts[part_of[other]] += part_of[other] != own
            for other, n in counts.items():
                if n % 2:
                    report(IN_SHELL, r, {k for k, p in part_of.items() if p == other})
    links = defaultdict(list)
    for point, rings in at_point.items():
        for p in {part_of[r] for r in rings}:
            links[p] += [(r, point) for r in rings if part_of[r] == p]
    cut = [p for own in links.values() for p in on_cycles(own)]
    if cut:
        found[APART] = min(cut)
    return [(kind, float(x), float(y)) for kind, (x, y) in found.items()]
