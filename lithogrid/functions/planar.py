"""SQL text for plane geometry.

Every snippet is written over struct names (``e`` an edge, ``quad`` the area,
``s`` a segment ...), so the same text serves a lambda over an array in the row
and a column after the array was exploded.
"""

from __future__ import annotations

_SIDES = (1, 2, 3, 4)


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` once inside a lambda."""
    return f"transform(array({value}), {name} -> {body})[0]"


# --- the area: a convex quadrilateral, a*(x - x0) + b*(z - z0) >= 0 on four sides ---------------

def quad_of(x: str, z: str) -> str:
    """Half planes of the quadrilateral with corner arrays ``x`` and ``z``.

    Each is taken from its corner: products with whole coordinates cancel, and
    what only touches the area would be decided by what they lose.
    """
    turn = f"sign({shoelace(x, z)})"
    fields = []
    for k in _SIDES:
        i, j = k - 1, k % 4
        a = f"({turn} * ({z}[{i}] - {z}[{j}]))"
        b = f"({turn} * ({x}[{j}] - {x}[{i}]))"
        fields.append(f"'a{k}', {a}, 'b{k}', {b}, 'x{k}', {x}[{i}], 'z{k}', {z}[{i}]")
    return f"named_struct({', '.join(fields)})"


def shoelace(x: str, z: str) -> str:
    """Signed planar area of a four-cornered ring."""
    terms = [f"{x}[{i}] * {z}[{(i + 1) % 4}] - {x}[{(i + 1) % 4}] * {z}[{i}]" for i in range(4)]
    return f"(({' + '.join(terms)}) / 2D)"


def side_value(k: int, x: str, z: str) -> str:
    """Signed distance from side ``k``, times its length; negative outside."""
    return f"(quad.b{k} * ({z} - quad.z{k}) + quad.a{k} * ({x} - quad.x{k}))"


def _side_z(k: int, x: str) -> str:
    return f"quad.z{k} - quad.a{k} * ({x} - quad.x{k}) / quad.b{k}"


def quad_bottom(x: str) -> str:
    """Lowest z of the area on the vertical line at ``x``."""
    cuts = [f"CASE WHEN quad.b{k} > 0 THEN {_side_z(k, x)} END" for k in _SIDES]
    return f"greatest({', '.join(cuts)})"


def quad_top(x: str) -> str:
    cuts = [f"CASE WHEN quad.b{k} < 0 THEN {_side_z(k, x)} END" for k in _SIDES]
    return f"least({', '.join(cuts)})"


# --- an edge against the area (Cyrus-Beck) ------------------------------------------------------

# Signed distances of both ends from the four sides, negative outside.
SIDE_VALUES = "named_struct({})".format(", ".join(
    f"'f{k}', {side_value(k, 'e.x1', 'e.z1')}, 'g{k}', {side_value(k, 'e.x2', 'e.z2')}" for k in _SIDES))

STARTS_INSIDE = " AND ".join(f"{side_value(k, 'e.x1', 'e.z1')} >= 0" for k in _SIDES)

ENDS_INSIDE = STARTS_INSIDE.replace("e.x1", "e.x2").replace("e.z1", "e.z2")

# Parameter range of the part inside, null when some side excludes the edge.
INSIDE_RANGE = "CASE WHEN NOT ({}) THEN named_struct('t0', greatest(0D, {}), 't1', least(1D, {})) END".format(
    " OR ".join(f"(f.f{k} < 0 AND f.g{k} < 0)" for k in _SIDES),
    ", ".join(f"CASE WHEN f.f{k} < 0 THEN f.f{k} / (f.f{k} - f.g{k}) END" for k in _SIDES),
    ", ".join(f"CASE WHEN f.g{k} < 0 THEN f.f{k} / (f.f{k} - f.g{k}) END" for k in _SIDES))

MEETS_AREA = f"coalesce({let('f', SIDE_VALUES, let('t', INSIDE_RANGE, 't.t0 <= t.t1'))}, false)"

# Clipped segment running in +x direction: start, direction and squared length.
_CLIPPED_ENDS = """named_struct(
  'px', e.x1 + t.t0 * (e.x2 - e.x1), 'pz', e.z1 + t.t0 * (e.z2 - e.z1),
  'qx', e.x1 + t.t1 * (e.x2 - e.x1), 'qz', e.z1 + t.t1 * (e.z2 - e.z1))"""
_RISING = """named_struct(
  'px', least(q.px, q.qx), 'pz', CASE WHEN q.px <= q.qx THEN q.pz ELSE q.qz END,
  'dx', abs(q.qx - q.px), 'dz', CASE WHEN q.px <= q.qx THEN q.qz - q.pz ELSE q.pz - q.qz END,
  'len2', (q.qx - q.px) * (q.qx - q.px) + (q.qz - q.pz) * (q.qz - q.pz))"""
CLIPPED_SEGMENT = let("f", SIDE_VALUES, let(
    "t", INSIDE_RANGE, f"CASE WHEN t.t0 <= t.t1 THEN {let('q', _CLIPPED_ENDS, _RISING)} END"))


# --- vertical lines -----------------------------------------------------------------------------

def crosses(x: str) -> str:
    """The edge passes the vertical line at ``x`` (half open, so vertices count once)."""
    return f"(e.x1 <= {x}) <> (e.x2 <= {x})"


def crossing_z(x: str) -> str:
    return f"e.z1 + (e.z2 - e.z1) * (({x} - e.x1) / (e.x2 - e.x1))"


def rests_on(x: str) -> str:
    """The edge reaches the line at ``x`` from the left without passing it."""
    return f"greatest(e.x1, e.x2) = {x}"


def resting_range(x: str) -> str:
    return (f"named_struct('lo', CASE WHEN e.x1 = e.x2 THEN least(e.z1, e.z2) WHEN e.x1 = {x} THEN e.z1 ELSE e.z2 END, "
            f"'hi', CASE WHEN e.x1 = e.x2 THEN greatest(e.z1, e.z2) WHEN e.x1 = {x} THEN e.z1 ELSE e.z2 END)")


# The points within ``radius`` of segment ``s``: reach in x, the two ends, and
# the straight parts of the outline, which touch the end discs ``shift`` beside
# the ends (at -shift above and +shift below).
CAPSULE = """named_struct(
  'west', s.px - radius, 'east', s.px + s.dx + radius,
  'px', s.px, 'pz', s.pz, 'qx', s.px + s.dx, 'qz', s.pz + s.dz, 'radius2', radius * radius,
  'shift', CASE WHEN s.len2 > 0 THEN radius * s.dz / sqrt(s.len2) ELSE 0D END,
  'slope', CASE WHEN s.dx > 0 THEN s.dz / s.dx ELSE 0D END,
  'above', CASE WHEN s.dx > 0 THEN radius * sqrt(s.len2) / s.dx WHEN s.len2 > 0 THEN greatest(s.dz, 0D) ELSE radius END,
  'below', CASE WHEN s.dx > 0 THEN -radius * sqrt(s.len2) / s.dx WHEN s.len2 > 0 THEN least(s.dz, 0D) ELSE -radius END)"""


def _outline(x: str, sign: str, shift: str, side: str) -> str:
    def disc(end: str) -> str:
        return f"s.{end}z {sign} sqrt(greatest(0D, s.radius2 - ({x} - s.{end}x) * ({x} - s.{end}x)))"

    return (f"CASE WHEN {x} > s.qx {shift} s.shift THEN {disc('q')} WHEN {x} < s.px {shift} s.shift THEN {disc('p')} "
            f"ELSE s.pz + ({x} - s.px) * s.slope + s.{side} END")


def capsule_top(x: str) -> str:
    """Highest z of capsule ``s`` on the vertical line at ``x`` within its reach."""
    return _outline(x, "+", "-", "above")


def capsule_bottom(x: str) -> str:
    return _outline(x, "-", "+", "below")


# --- cells --------------------------------------------------------------------------------------

def first_cell(position: str) -> str:
    """Index of the first cell whose centre is at or after ``position``."""
    return f"ceil({position} / r - 0.5D)"


def last_cell(position: str) -> str:
    return f"floor({position} / r - 0.5D)"


def centre(cell: str) -> str:
    return f"(({cell} + 0.5D) * r)"


def disjoint(ranges: str) -> str:
    """Sorted ``array<struct<z0, z1>>`` without overlaps, same cells covered."""
    return f"""filter(transform({ranges}, (v, i) -> named_struct(
        'z0', CASE WHEN i = 0 THEN v.z0
                   ELSE greatest(v.z0, array_max(slice({ranges}, 1, i).z1) + 1) END,
        'z1', v.z1)), v -> v.z0 <= v.z1)"""
