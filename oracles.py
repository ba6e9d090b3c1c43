"""Plain SQL for the same questions, by brute force where that is simpler.

Nothing here shares the engine's geometry: cells are tested one by one against
edges, and the projection is a fixed number of Vincenty rounds.
"""

from __future__ import annotations

import re

from lithogrid.operators import areas as area_ops
from lithogrid.operators import evidence, report
from lithogrid.operators import validity
from lithogrid.plans import build, derived
from lithogrid.sources import config, osm

num = derived.num


def named(sql: str) -> str:
    """Table placeholders to table names."""
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        sql = sql.replace("{" + table + "}", table)
    return sql


# --- projection ---------------------------------------------------------------------------------

F_, B_ = "(1 / cast('298.257223563' as double))", f"({num('6378137')} * (1 - 1 / {num('298.257223563')}))"


def project(source: str, rounds: int = 6) -> str:
    """``source`` has lon, lat, lon0, lat0; adds x and z, one alias per step."""
    steps = [
        ("p_f", F_), ("p_b", B_),
        ("p_t1", "(1 - p_f) * tan(radians(lat0))"), ("p_c1", "1 / sqrt(1 + p_t1 * p_t1)"), ("p_s1", "p_t1 * p_c1"),
        ("p_t2", "(1 - p_f) * tan(radians(lat))"), ("p_c2", "1 / sqrt(1 + p_t2 * p_t2)"), ("p_s2", "p_t2 * p_c2"),
        ("p_l0", "radians(lon - lon0)"),
    ]

    def arc(k: int) -> list:
        lam = f"p_l{k}"
        return [
            (f"p_e{k}", f"p_c2 * sin({lam})"),
            (f"p_n{k}", f"p_c1 * p_s2 - p_s1 * p_c2 * cos({lam})"),
            (f"p_ss{k}", f"sqrt(p_e{k} * p_e{k} + p_n{k} * p_n{k})"),
            (f"p_cs{k}", f"p_s1 * p_s2 + p_c1 * p_c2 * cos({lam})"),
            (f"p_sg{k}", f"atan2(p_ss{k}, p_cs{k})"),
            (f"p_sa{k}", f"coalesce(p_c1 * p_e{k} / nullif(p_ss{k}, 0), 0)"),
            (f"p_ca{k}", f"1 - p_sa{k} * p_sa{k}"),
            (f"p_cm{k}", f"p_cs{k} - coalesce(2 * p_s1 * p_s2 / nullif(p_ca{k}, 0), 0)"),
        ]

    for k in range(rounds):
        steps += arc(k) + [
            (f"p_k{k}", f"p_f / 16 * p_ca{k} * (4 + p_f * (4 - 3 * p_ca{k}))"),
            (f"p_l{k + 1}", f"p_l0 + (1 - p_k{k}) * p_f * p_sa{k} * (p_sg{k} + p_k{k} * p_ss{k} * "
                            f"(p_cm{k} + p_k{k} * p_cs{k} * (2 * p_cm{k} * p_cm{k} - 1)))"),
        ]
    k = rounds
    steps += arc(k) + [
        ("p_u", f"p_ca{k} * ({num('6378137')} * {num('6378137')} / (p_b * p_b) - 1)"),
        ("p_aa", "1 + p_u / 16384 * (4096 + p_u * (-768 + p_u * (320 - 175 * p_u)))"),
        ("p_bb", "p_u / 1024 * (256 + p_u * (-128 + p_u * (74 - 47 * p_u)))"),
        ("p_ds", f"p_bb * p_ss{k} * (p_cm{k} + p_bb / 4 * (p_cs{k} * (2 * p_cm{k} * p_cm{k} - 1) - p_bb / 6 * p_cm{k} "
                 f"* (4 * p_ss{k} * p_ss{k} - 3) * (4 * p_cm{k} * p_cm{k} - 3)))"),
        ("p_q", f"coalesce(p_b * p_aa * (p_sg{k} - p_ds) / nullif(p_ss{k}, 0), 0)"),
        ("x", f"p_q * p_e{k}"), ("z", f"p_q * p_n{k}"),
    ]
    # One subquery per step that refers to an alias of the step before it:
    # aliases within one SELECT would be expanded in place, over and over.
    levels, known = [], set()
    for name, sql in steps:
        if not levels or any(re.search(rf"\b{n}\b", sql) for n in known):
            levels.append([])
            known = set()
        levels[-1].append(f"{sql} as {name}")
        known.add(name)
    nested = source
    for n, level in enumerate(levels):
        nested = f"(select *, {', '.join(level)} from {nested} as s{n})"
    hidden = ", ".join(n for n, _ in steps if n not in ("x", "z"))
    return f"(select * exclude ({hidden}) from {nested} as chain)"


def tidy(value: str) -> str:
    """Four decimals without a negative zero."""
    return f"case when round({value}, 4) = 0 then {num('0')} else round({value}, 4) end"


def frames(areas_sql: str) -> str:
    """CTEs ``area`` and ``corner``: centre and projected corners, in order around the box."""
    return f"""area as (select *, (west + east) / 2 as lon0, (south + north) / 2 as lat0 from ({named(areas_sql)}) as a0),
corner as (select area_id, k, x, z from {project('''(select area_id, lon0, lat0, k,
    case when k in (0, 3) then west else east end as lon, case when k in (0, 1) then south else north end as lat
    from area, (values (0), (1), (2), (3)) as ks(k))''')} as pc),
side as (select c.area_id, c.k, c.x as ax, c.z as az, d.x as bx, d.z as bz
  from corner c join corner d on c.area_id = d.area_id and d.k = (c.k + 1) % 4)"""


def in_quad(x: str, z: str, area: str) -> str:
    return (f"not exists (select 1 from side q where q.area_id = {area} and "
            f"(q.bx - q.ax) * ({z} - q.az) - (q.bz - q.az) * ({x} - q.ax) < 0)")


# --- footprints ---------------------------------------------------------------------------------

def _offsets(vertices: dict) -> str:
    rows = [f"({shape}, {k}, {i}, {num(str(u))}, {num(str(v))})" for shape, rings in vertices.items()
            for k, ring in enumerate(rings) for i, (u, v) in enumerate(ring)]
    return f"(values {', '.join(rows)}) as offs(shape, ring, i, u, v)"


FOOTPRINTS = f"""{frames(derived.AREAS_SQL)},
foot as ({named(derived.FOOTPRINTS_SQL)}),
vertex as (select pos, area_id, ring, i, x, z from {project(f'''(select f.pos, f.area_id, o.ring, o.i, f.w + f.dx * o.u as lon,
    f.s + f.dy * o.v as lat, a.lon0, a.lat0 from foot f join {_offsets(derived.FOOTPRINT_VERTICES)} on f.shape = offs.shape
    join area a on a.area_id = f.area_id)'''.replace('o.ring', 'offs.ring').replace('o.i,', 'offs.i,').replace('o.u', 'offs.u').replace('o.v', 'offs.v'))} as pv),
edge as (select v.pos, v.area_id, v.x as x1, v.z as z1, w.x as x2, w.z as z2
  from vertex v join vertex w on v.pos = w.pos and v.ring = w.ring and w.i = v.i + 1),
box as (select v.pos, v.area_id, any_value(a.voxel_size_m) as r,
    cast(floor(min(x) / any_value(a.voxel_size_m)) as bigint) as x0, cast(ceil(max(x) / any_value(a.voxel_size_m)) as bigint) as x1,
    cast(floor(min(z) / any_value(a.voxel_size_m)) as bigint) as z0, cast(ceil(max(z) / any_value(a.voxel_size_m)) as bigint) as z1
  from vertex v join area a on a.area_id = v.area_id group by v.pos, v.area_id),
grid as (select pos, area_id, r, cx, cz, (cx + {num('0.5')}) * r as px, (cz + {num('0.5')}) * r as pz from (
    select pos, area_id, r, z0, z1, unnest(generate_series(x0, x1 - 1)) as cx from box) as gx,
    lateral (select unnest(generate_series(z0, z1 - 1)) as cz) as gz),
cell as (select g.pos, g.area_id, g.r, g.cx, g.cz from grid g join edge e on e.pos = g.pos
  group by g.pos, g.area_id, g.r, g.cx, g.cz, g.px, g.pz
  having sum(case when (e.x1 <= g.px) <> (e.x2 <= g.px)
      and g.pz < e.z1 + (e.z2 - e.z1) * (g.px - e.x1) / nullif(e.x2 - e.x1, 0) then 1 else 0 end) % 2 = 1),
inside as (select c.* from cell c where {in_quad(f'(c.cx + {num("0.5")}) * c.r', f'(c.cz + {num("0.5")}) * c.r', 'c.area_id')}),
layered as (select i.pos, i.area_id, i.cx, i.cz, cast(floor(f.base / i.r) as bigint) as y0,
    cast(ceil((f.base + f.height) / i.r) as bigint) as y1 from inside i join foot f on f.pos = i.pos)"""

PER_FEATURE = """select area_id, pos, count(*) as cells, cast(sum(y1 - y0) as bigint) as voxels,
  min(cx) as min_x, max(cx) as max_x, min(cz) as min_z, max(cz) as max_z from layered group by area_id, pos"""

_CLIPPED_EDGES = """meets as (select e.pos, e.area_id, max(greatest(0, case when f1 < 0 then f1 / (f1 - f2) else 0 end)) as t0,
    min(least(1, case when f2 < 0 then f1 / (f1 - f2) else 1 end)) as t1, max(case when f1 < 0 and f2 < 0 then 1 else 0 end) as gone
  from (select e.pos, e.area_id, e.n, (q.bx - q.ax) * (e.z1 - q.az) - (q.bz - q.az) * (e.x1 - q.ax) as f1,
      (q.bx - q.ax) * (e.z2 - q.az) - (q.bz - q.az) * (e.x2 - q.ax) as f2
    from (select *, row_number() over () as n from edge) e join side q on q.area_id = e.area_id) e
  group by e.pos, e.area_id, e.n)"""

# --- lines --------------------------------------------------------------------------------------

LINES = f"""{frames(derived.AREAS_SQL)},
raw as (select * from ({named(derived.LINE_VERTICES_SQL)}) as lv qualify count(*) over (partition by pos) = 1
  or min(lon) over (partition by pos) < max(lon) over (partition by pos)
  or min(lat) over (partition by pos) < max(lat) over (partition by pos)),
point as (select pos, area_id, width, base, height, n, x, z from {project('''(select r.pos, r.area_id, r.width, r.base, r.height,
    r.lon, r.lat, a.lon0, a.lat0, row_number() over (partition by r.pos order by r.i, r.lon, r.lat) as n
    from raw r join area a on a.area_id = r.area_id)''')} as pp),
segment as (select p.pos, p.area_id, p.n, p.x as x1, p.z as z1, q.x as x2, q.z as z2 from point p join point q
    on q.pos = p.pos and q.n = p.n + 1
  union all
  select pos, area_id, 1, x, z, x, z from point p where not exists (select 1 from point q where q.pos = p.pos and q.n = 2)),
ranged as (select pos, area_id, n, x1, z1, x2, z2,
    greatest(0, max(case when f1 < 0 then f1 / nullif(f1 - f2, 0) else 0 end)) as t0,
    least(1, min(case when f2 < 0 then f1 / nullif(f1 - f2, 0) else 1 end)) as t1
  from (select s.*, (q.bx - q.ax) * (s.z1 - q.az) - (q.bz - q.az) * (s.x1 - q.ax) as f1,
      (q.bx - q.ax) * (s.z2 - q.az) - (q.bz - q.az) * (s.x2 - q.ax) as f2
    from segment s join side q on q.area_id = s.area_id) as sq
  group by pos, area_id, n, x1, z1, x2, z2
  having max(case when f1 < 0 and f2 < 0 then 1 else 0 end) = 0),
clipped as (select pos, area_id, n, x1 + t0 * (x2 - x1) as px, z1 + t0 * (z2 - z1) as pz,
    x1 + t1 * (x2 - x1) as qx, z1 + t1 * (z2 - z1) as qz from ranged where t0 <= t1)"""

CAPSULES = f"""{LINES},
spec as (select pos, any_value(area_id) as area_id, any_value(width) / 2 as radius, any_value(base) as base,
    any_value(height) as height from point group by pos),
reach as (select c.*, s.radius, a.voxel_size_m as r from clipped c join spec s on s.pos = c.pos join area a on a.area_id = c.area_id),
grid as (select *, (cx + {num('0.5')}) * r as gx, (cz + {num('0.5')}) * r as gz from (
    select *, unnest(generate_series(cast(floor((least(px, qx) - radius) / r) as bigint), cast(ceil((greatest(px, qx) + radius) / r) as bigint))) as cx
    from reach) as g1, lateral (select unnest(generate_series(cast(floor((least(g1.pz, g1.qz) - g1.radius) / g1.r) as bigint),
      cast(ceil((greatest(g1.pz, g1.qz) + g1.radius) / g1.r) as bigint))) as cz) as g2),
near as (select *, greatest(0, least(1, coalesce(((gx - px) * (qx - px) + (gz - pz) * (qz - pz))
    / nullif((qx - px) * (qx - px) + (qz - pz) * (qz - pz), 0), 0))) as t from grid),
cell as (select distinct pos, area_id, r, cx, cz, gx, gz from near
  where (gx - px - t * (qx - px)) * (gx - px - t * (qx - px)) + (gz - pz - t * (qz - pz)) * (gz - pz - t * (qz - pz)) <= radius * radius),
layered as (select c.pos, c.area_id, c.cx, c.cz, cast(floor(s.base / c.r) as bigint) as y0,
    cast(ceil((s.base + s.height) / c.r) as bigint) as y1
  from cell c join spec s on s.pos = c.pos where {in_quad('c.gx', 'c.gz', 'c.area_id')})"""

# --- stars --------------------------------------------------------------------------------------

_WEST, _SOUTH, _EAST, _NORTH = (num(str(v)) for v in derived.STAR_AREA)
_STAR_AREA_SQL = (f"select 'stars' as area_id, {_WEST} as west, {_SOUTH} as south, {_EAST} as east, {_NORTH} as north")
STAR_RINGS = f"""star as ({named(derived.STAR_VERTICES_SQL)}),
ordered as (select *, row_number() over (partition by pos order by i) as n, count(*) over (partition by pos) as m from star),
ring as (select pos, n, m, lon, lat from ordered where m > 2
  union all select pos, m + 1, m, lon, lat from ordered where n = 1 and m > 2)"""
STARS = f"""{frames(_STAR_AREA_SQL)}, {STAR_RINGS},
vertex as (select pos, n, x, z from {project('(select r.*, a.lon0, a.lat0 from ring r, area a)')} as pv),
edge as (select v.pos, v.x as x1, v.z as z1, w.x as x2, w.z as z2 from vertex v join vertex w on w.pos = v.pos and w.n = v.n + 1),
box as (select pos, cast(floor(min(x)) as bigint) as x0, cast(ceil(max(x)) as bigint) as x1,
    cast(floor(min(z)) as bigint) as z0, cast(ceil(max(z)) as bigint) as z1 from vertex group by pos),
grid as (select pos, cx, cz from (select *, unnest(generate_series(x0, x1 - 1)) as cx from box) as b,
    lateral (select unnest(generate_series(b.z0, b.z1 - 1)) as cz) as c),
cell as (select g.pos, g.cx, g.cz from grid g join edge e on e.pos = g.pos
    and (e.x1 <= g.cx + {num('0.5')}) <> (e.x2 <= g.cx + {num('0.5')})
  group by g.pos, g.cx, g.cz having sum(case when g.cz + {num('0.5')} <
      e.z1 + (e.z2 - e.z1) * ((g.cx + {num('0.5')} - e.x1) / (e.x2 - e.x1)) then 1 else 0 end) % 2 = 1),
layered as (select 'stars' as area_id, pos, cx, cz, cast(0 as bigint) as y0, cast(2 as bigint) as y1 from cell c
  where {in_quad(f'(c.cx + {num("0.5")})', f'(c.cz + {num("0.5")})', "'stars'")})"""


# --- validity -----------------------------------------------------------------------------------

def _side(p: str, x: str, y: str) -> str:
    return f"(({p}.x2 - {p}.x1) * ({y} - {p}.y1) - ({p}.y2 - {p}.y1) * ({x} - {p}.x1))"


def _on(p: str, x: str, y: str) -> str:
    return (f"({_side(p, x, y)} = 0 and {x} between least({p}.x1, {p}.x2) and greatest({p}.x1, {p}.x2) "
            f"and {y} between least({p}.y1, {p}.y2) and greatest({p}.y1, {p}.y2))")


# ``ring_edge(pos, ring, n, m, x1, y1, x2, y2)``: n counts from 1 to m, repeated vertices removed.
_PAIRS = f"""pair as (select a.pos, a.ring as ra, b.ring as rb, a.n as na, b.n as nb, a.m,
    a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2,
    {_side('a', 'b.x1', 'b.y1')} as b1, {_side('a', 'b.x2', 'b.y2')} as b2,
    {_side('b', 'a.x1', 'a.y1')} as a1, {_side('b', 'a.x2', 'a.y2')} as a2,
    ({_on('a', 'b.x1', 'b.y1')} or {_on('a', 'b.x2', 'b.y2')} or {_on('b', 'a.x1', 'a.y1')} or {_on('b', 'a.x2', 'a.y2')}) as touch
  from ring_edge a join ring_edge b on a.pos = b.pos and (a.ring < b.ring or (a.ring = b.ring and a.n < b.n))),
crossed as (select distinct pos from pair where (sign(b1) * sign(b2) < 0 and sign(a1) * sign(a2) < 0)
  or (b1 = 0 and b2 = 0 and (least(greatest(ax1, ax2), greatest(bx1, bx2)) > greatest(least(ax1, ax2), least(bx1, bx2))
    or least(greatest(ay1, ay2), greatest(by1, by2)) > greatest(least(ay1, ay2), least(by1, by2))))),
touched as (select distinct pos from pair where touch and ra = rb and nb - na <> 1 and nb - na <> m - 1)"""

VALIDITY = f"""with recursive foot as ({named(derived.SHAPES_SQL)}),
corner0 as (select f.pos, offs.ring, offs.i, f.w + f.dx * offs.u as x, f.s + f.dy * offs.v as y
  from foot f join {_offsets(derived.SHAPES)} on f.shape = offs.shape),
kept as (select * from (select *, lag(x) over (partition by pos, ring order by i) as lx,
    lag(y) over (partition by pos, ring order by i) as ly from corner0) as c where lx is null or lx <> x or ly <> y),
numbered as (select pos, ring, x, y, row_number() over (partition by pos, ring order by i) as n,
    count(*) over (partition by pos, ring) - 1 as m from kept),
ring_edge as (select a.pos, a.ring, a.n, a.m, a.x as x1, a.y as y1, b.x as x2, b.y as y2
  from numbered a join numbered b on a.pos = b.pos and a.ring = b.ring and b.n = a.n + 1),
{_PAIRS},
few as (select distinct pos from numbered where m < 3),
placed as (select v.pos, v.ring, v.n, e.ring as other,
    sum(case when (e.y1 <= v.y1) <> (e.y2 <= v.y1) and v.x1 < e.x1 + (e.x2 - e.x1) * (v.y1 - e.y1) / nullif(e.y2 - e.y1, 0)
      then 1 else 0 end) % 2 as odd, bool_or({_on('e', 'v.x1', 'v.y1')}) as edge_on
  from ring_edge v join ring_edge e on e.pos = v.pos and e.ring <> v.ring where v.ring > 0 group by v.pos, v.ring, v.n, e.ring),
outside as (select distinct pos from placed where other = 0 and odd = 0 and not edge_on),
nested as (select distinct pos from placed where other > 0 and odd = 1 and not edge_on),
meet as (select distinct pos, ra, rb, case when {_on('a', 'bx1', 'by1')} then bx1 else ax1 end as tx,
      case when {_on('a', 'bx1', 'by1')} then by1 else ay1 end as ty
    from (select *, ax1 as x1, ay1 as y1, ax2 as x2, ay2 as y2 from pair) as a where ra <> rb
      and ({_on('a', 'bx1', 'by1')} or (ax1 = bx1 and ay1 = by1))),
link as (select pos, ra as ring, tx, ty from meet union select pos, rb, tx, ty from meet),
reach as (select pos, ring, ring as other from link union
  select r.pos, r.ring, b.ring from reach r join link a on a.pos = r.pos and a.ring = r.other
    join link b on b.pos = a.pos and b.tx = a.tx and b.ty = a.ty),
tree as (select pos, count(distinct least) as trees from (select pos, ring, min(other) as least from reach group by pos, ring) as t group by pos),
apart as (select l.pos from (select pos, count(*) as links, count(distinct ring) + count(distinct (tx, ty)) as nodes
    from link group by pos) as l join tree on tree.pos = l.pos where links > nodes - trees)
select f.pos, case when few.pos is not null then '{validity.TOO_FEW_POINTS}'
    when crossed.pos is not null then '{validity.SELF_INTERSECTION}'
    when touched.pos is not null then '{validity.RING_SELF_INTERSECTION}'
    when outside.pos is not null then '{validity.HOLE_OUTSIDE}'
    when nested.pos is not null then '{validity.NESTED_HOLES}'
    when apart.pos is not null then '{validity.DISCONNECTED}' else '' end as reason
from foot f left join few on few.pos = f.pos left join crossed on crossed.pos = f.pos left join touched on touched.pos = f.pos
  left join outside on outside.pos = f.pos left join nested on nested.pos = f.pos left join apart on apart.pos = f.pos"""

VALIDITY_LARGE = f"""with {STAR_RINGS},
ring_edge as (select a.pos, 0 as ring, a.n, a.m, a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2
  from ring a join ring b on b.pos = a.pos and b.n = a.n + 1),
{_PAIRS}
select r.pos, case when crossed.pos is not null then '{validity.SELF_INTERSECTION}'
    when touched.pos is not null then '{validity.RING_SELF_INTERSECTION}' else '' end as reason
from (select distinct pos from ring) as r left join crossed on crossed.pos = r.pos left join touched on touched.pos = r.pos"""


# --- evidence -----------------------------------------------------------------------------------

def _spelled(values: list, name: str) -> str:
    """VALUES of the JSON spellings: index, state (absent, null, text, other) and content."""
    def row(i: int, v: str | None) -> str:
        if v is None:
            return f"({i}, 'absent', '')"
        if v == "null":
            return f"({i}, 'null', '')"
        if v.startswith('"'):
            return f"({i}, 'text', '{v.strip(chr(34))}')"
        return f"({i}, '{ {'t': 'bool', '[': 'list'}.get(v[0], 'number') }', '{v}')"

    return f"(values {', '.join(row(i, v) for i, v in enumerate(values))}) as {name}(i, state, content)"


def _float(text: str) -> str:
    t = f"trim({text})"
    return (f"case when regexp_full_match({t}, '[+-]?([0-9]+(_[0-9]+)*\\.?([0-9]+(_[0-9]+)*)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?') "
            f"then try_cast(replace({t}, '_', '') as double) when lower({t}) in ('inf', 'nan') then try_cast({t} as double) end")


def _number(v: str) -> str:
    return f"case when {v}.state = 'bool' then {num('1')} when {v}.state = 'list' then null else {_float(v + '.content')} end"


EVIDENCE = f"""with picked as (select o_orderkey as pos, h.state as hs, h.content as hc, g.state as gs, g.content as gc,
    b.state as bs, w.state as ws, {_number('b')} as bn, {_number('w')} as wn, k.state as ks, k.content as kc
  from orders join {_spelled(derived.HEIGHTS, 'h')} on h.i = o_orderkey % {len(derived.HEIGHTS)}
    join {_spelled(derived.FALLBACK_HEIGHTS, 'g')} on g.i = cast(floor(o_orderkey / 3) as bigint) % {len(derived.FALLBACK_HEIGHTS)}
    join {_spelled(derived.BASES, 'b')} on b.i = cast(floor(o_orderkey / 7) as bigint) % {len(derived.BASES)}
    join {_spelled(derived.WIDTHS, 'w')} on w.i = cast(floor(o_orderkey / 11) as bigint) % {len(derived.WIDTHS)}
    join {_spelled(derived.KINDS, 'k')} on k.i = cast(floor(o_orderkey / 2) as bigint) % {len(derived.KINDS)}),
chosen as (select *, pos % 2 = 0 as thick, case when hs = 'absent' then gs else hs end as es,
    regexp_replace(case when hs = 'absent' then gc else hc end, ' m$', '') as ec from picked),
valued as (select *, case when es in ('absent', 'null') then {num('1')} when es in ('bool', 'list') then null else {_float('ec')} end as hn,
    case when not thick then null when ws in ('absent', 'null') then {num('1')} else wn end as width,
    case when bs = 'absent' then {num('0')} when bs = 'null' then null else bn end as base from chosen)
select pos, case when ks = 'absent' then '{evidence.DEFAULT_KIND}' else kc end as kind,
  coalesce(width, -1) as width, coalesce(base, -999) as base, coalesce(hn, 1) as height,
  concat_ws('|', case when thick and ws in ('absent', 'null') then '{evidence.WIDTH_ASSUMED}' end,
    case when bs = 'absent' then '{evidence.BASE_ASSUMED}' end,
    case when es in ('absent', 'null') then '{evidence.HEIGHT_ASSUMED}' end,
    case when hn is null then '{evidence.HEIGHT_UNREADABLE}' end) as assumptions,
  thick and (width is null or isnan(width) or isinf(width) or width <= 0) as bad_width,
  base is null or isnan(base) or isinf(base) or isnan(coalesce(hn, 1)) or isinf(coalesce(hn, 1)) or coalesce(hn, 1) <= 0 as bad_elevation
from valued"""

# Dropped footprints keep their warnings, so issues need no geometry.
_GAPS = f"""concat_ws('|', case when pos % 5 = 0 then '{evidence.BASE_ASSUMED}' end,
    case when c_acctbal < 0 then '{evidence.HEIGHT_ASSUMED}' end)"""
ISSUES = f"""select area_id, pos, concat('b', cast(pos as varchar)) as feature, 'warning' as severity, {_GAPS} as reasons
from ({named(derived.FOOTPRINTS_SQL)}) as f where pos % 5 = 0 or c_acctbal < 0"""

REGISTRY = f"""with listed as ({named(derived.SUPPLIER_SOURCES_SQL)})
select area_id, id, first_pos as pos, url, license, url <> '' and license <> '' as complete from (
  select *, row_number() over (partition by area_id, id order by pos desc) as k,
    min(pos) over (partition by area_id, id) as first_pos from listed) as l where k = 1"""

# --- OpenStreetMap ------------------------------------------------------------------------------

CLASSIFIED = f"""element as ({named(derived.ELEMENTS_SQL)}),
classified as (select *, case when coalesce(tag_attraction, '') <> '' or coalesce(tag_roller_coaster, '') <> '' then 'attraction'
    when tag_natural = 'water' then 'water' when tag_amenity = 'parking' then 'parking' when tag_building is not null then 'building'
    when tag_highway is not null then 'path' when tag_waterway is not null then 'water' end as kind from element),
kept as (select *, case when type <> 'way' then '{osm.NOT_A_WAY}' when n_vertices < 2 then '{osm.NO_GEOMETRY}' end as reason
  from classified where kind is not null)"""


def _vertex(i: int) -> str:
    u, v = derived.ELEMENT_OFFSETS[i]
    return f"({i + 1}, {num(str(u))} * {num('1e-5')}, {num(str(v))} * {num('1e-5')})"


_OFFSETS = f"(values {', '.join(_vertex(i) for i in range(5))}) as offs(i, u, v)"
SELECTED = f"""with {CLASSIFIED}, area as ({named(derived.AREAS_SQL)}),
way as (select e.pos, e.area_id, o.i, e.w + o.u as x, e.s + o.v as y from element e join {_OFFSETS} on o.i <= e.n_vertices
  where e.type = 'way'),
legs as (select a.pos, a.area_id, a.x as x1, a.y as y1, coalesce(b.x, a.x) as x2, coalesce(b.y, a.y) as y2
  from way a left join way b on b.pos = a.pos and b.i = a.i + 1),
met as (select distinct l.pos from legs l join area a on a.area_id = l.area_id
  where least(x1, x2) <= east and greatest(x1, x2) >= west and least(y1, y2) <= north and greatest(y1, y2) >= south)
select area_id, type, count(*) as elements from (
  select e.area_id, e.type from element e join met on met.pos = e.pos
  union all
  select e.area_id, e.type from element e join area a on a.area_id = e.area_id where e.type = 'relation'
    and e.w <= a.east and e.w + {num('9')} * {num('1e-5')} >= a.west and e.s <= a.north and e.s + {num('7')} * {num('1e-5')} >= a.south) as u
group by area_id, type""".replace("o.i", "offs.i").replace("o.u", "offs.u").replace("o.v", "offs.v")

# --- report -------------------------------------------------------------------------------------

# Heights and bases as assumed where they lack.
REPORT = f"""with {FOOTPRINTS}, {_CLIPPED_EDGES}, {CLASSIFIED},
patched as (select pos, case when c_acctbal < 0 then {num('1')} else height end as height,
    case when pos % 5 = 0 then {num('0')} else base end as base from foot),
counts as (select i.area_id, cast(sum(ceil((p.base + p.height) / i.r) - floor(p.base / i.r)) as bigint) as voxel_records
  from inside i join patched p on p.pos = i.pos group by i.area_id),
accepted as (select area_id, count(distinct pos) as features from meets where gone = 0 and t0 <= t1 group by area_id),
gaps as (select area_id, count(*) as warnings from foot where pos % 5 = 0 or c_acctbal < 0 group by area_id),
skips as (select area_id, count(*) as skipped_osm from kept where reason is not null group by area_id)
select a.area_id, a.voxel_size_m, coalesce(c.voxel_records, 0) as voxel_records, coalesce(n.features, 0) as features,
  cast(0 as bigint) as errors, coalesce(g.warnings, 0) as warnings, coalesce(s.skipped_osm, 0) as skipped_osm,
  a.strict and (coalesce(g.warnings, 0) + coalesce(s.skipped_osm, 0) > 0 or coalesce(n.features, 0) = 0) as strict_failed
from area a left join counts c on c.area_id = a.area_id left join accepted n on n.area_id = a.area_id
  left join gaps g on g.area_id = a.area_id left join skips s on s.area_id = a.area_id"""

_LIMITATIONS = "|".join(report.LIMITATIONS)
HEADER = f"""with {CLASSIFIED}, area as ({named(derived.AREAS_SQL)}),
foot as ({named(derived.FOOTPRINTS_SQL)}),
tally as (select area_id, count(*) as features, cast(sum(pos) as bigint) as voxel_records, count(*) filter (pos % 7 = 0) as errors
  from foot group by area_id),
skips as (select area_id, count(*) as skipped_osm from kept where reason is not null group by area_id)
select a.area_id, '{report.VERSION}' as version, round((south + north) / 2, 9) as lat_0, round((west + east) / 2, 9) as lon_0,
  '+proj=aeqd +lat_0= +lon_0= +datum=WGS84 +units=m' as crs, 'east,up,north' as axis, '{_LIMITATIONS}' as limitations,
  coalesce(voxel_records, 0) as voxel_records, coalesce(features, 0) as features, coalesce(errors, 0) as errors,
  coalesce(skipped_osm, 0) as skipped_osm,
  a.strict and (coalesce(errors, 0) + coalesce(skipped_osm, 0) > 0 or coalesce(features, 0) = 0) as strict_failed
from area a left join tally t on t.area_id = a.area_id left join skips s on s.area_id = a.area_id"""

LISTS = f"""with {CLASSIFIED}, listed as ({REGISTRY.replace('with listed as', 'with listed0 as').replace('from listed)', 'from listed0)')})
select area_id, list, cast(floor(pos / 4096) as bigint) as piece, cast(count(*) as integer) as entries from (
  select area_id, 'sources' as list, pos from listed
  union all select area_id, 'issues', pos from ({ISSUES}) as i
  union all select area_id, 'skipped_osm', pos from kept where reason is not null) as l
group by area_id, list, cast(floor(pos / 4096) as bigint)"""

QUAD = f"""with {frames(derived.PART_AREAS_SQL)},
flat as (select area_id, {', '.join(f"max(case when k = {i} then {c} end) as {c}{i}" for c in 'xz' for i in range(4))}
  from corner group by area_id),
sized as (select *, abs(x0 * z1 - x1 * z0 + x1 * z2 - x2 * z1 + x2 * z3 - x3 * z2 + x3 * z0 - x0 * z3) / 2 as m2 from flat)"""

def _clipped_rings() -> str:
    """Sutherland-Hodgman, one CTE pair for each side of the area; ``closed`` has the rings of the export."""
    ctes = ["""inner_foot as (select pos from foot f where not exists (select 1 from vertex v join side q on q.area_id = v.area_id
      where v.pos = f.pos and (q.bx - q.ax) * (v.z - q.az) - (q.bz - q.az) * (v.x - q.ax) < 0))""",
            """c0 as (select pos, area_id, ring, i, x, z from (select *, max(i) over (partition by pos, ring) as n from vertex) as v
      where i < n and pos not in (select pos from inner_foot) and pos in (select pos from hit))"""]
    for k in range(4):
        value = "(q.bx - q.ax) * ({1} - q.az) - (q.bz - q.az) * ({0} - q.ax)"
        ctes.append(f"""p{k} as (select t.*, {value.format('x', 'z')} as vp, {value.format('nx', 'nz')} as vq from (
          select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(z) over w, first_value(z) over w) as nz
          from c{k} window w as (partition by pos, ring order by i)) as t join side q on q.area_id = t.area_id and q.k = {k})""")
        ctes.append(f"""c{k + 1} as (select pos, area_id, ring, row_number() over (partition by pos, ring order by i, sub) - 1 as i, x, z from (
          select pos, area_id, ring, i, 0 as sub, x + (nx - x) * (vp / (vp - vq)) as x, z + (nz - z) * (vp / (vp - vq)) as z
            from p{k} where (vp >= 0) <> (vq >= 0)
          union all select pos, area_id, ring, i, 1, nx, nz from p{k} where vq >= 0) as u)""")
    ctes.append("""counted as (select *, count(*) over (partition by pos, ring) as n from c4)""")
    ctes.append("""closed as (select pos, area_id, ring, i, x, z from counted where n > 2
      union all select pos, area_id, ring, n, x, z from counted where n > 2 and i = 0
      union all select pos, area_id, ring, i, x, z from vertex where pos in (select pos from inner_foot))""")
    return ", ".join(ctes)


ORACLES = {
    "voxels": f"""with {FOOTPRINTS} select l.area_id, l.cx as x, y, l.cz as z, 'building' as kind,
      concat('b', cast(l.pos as varchar)) as feature, r_name as source
    from (select *, unnest(generate_series(y0, y1 - 1)) as y from layered where y0 < y1) as l
      join customer on c_custkey = l.pos join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""",
    "footprint_cells": f"with {FOOTPRINTS} {PER_FEATURE}",
    "capsule_cells": f"with {CAPSULES} {PER_FEATURE}",
    "voxel_counts": f"""select area_id, kind, cast(sum(y1 - y0) as bigint) as voxel_records from (
      select area_id, 'building' as kind, y0, y1 from (with {FOOTPRINTS} select * from layered) as p
      union all select area_id, 'path', y0, y1 from (with {CAPSULES} select * from layered) as l) as u group by area_id, kind""",
    "voxel_budget": f"""with {FOOTPRINTS} select a.area_id, {build.BUDGET_CHECK} as stage,
      case when a.nation % 10 = 4 then '{build.NO_BUDGET}' else '{build.VOXELS_OVER_BUDGET}' end as message
    from area a left join (select area_id, sum(y1 - y0) as n from layered group by area_id) as c on c.area_id = a.area_id
    where coalesce(n, 0) > 500 * (a.nation % 10) or a.nation % 10 = 4""",
    "report_header": HEADER,
    "split_collections": f"""select area_id, row_number() over (partition by area_id order by pos) - 1 as pos,
      concat('b', cast(pos as varchar)) as id, 'building' as kind, cast(case shape when 0 then 4 when 1 then 5 else 10 end as bigint) as vertices,
      round(w, 6) as west, round(s, 6) as south from ({named(derived.FOOTPRINTS_SQL)}) as f""",
    "large_polygon_cells": f"with {STARS} {PER_FEATURE}",
    "project_vertices": f"""with {FOOTPRINTS} select pos, cast(row_number() over (partition by pos order by ring, i) - 1 as integer) as i,
      {tidy('x')} as x, {tidy('z')} as z from vertex""",
    "area_quad": f"""{QUAD} select area_id, {', '.join(f'{tidy(c + str(i))} as {c}{i}' for c in 'xz' for i in range(4))},
      round(m2, 2) as area_m2 from sized""",
    "area_gates": f"""{QUAD}, staged as (select a.area_id,
      case when not (-180 <= west and west < east and east <= 180 and -90 < south and south < north and north < 90)
          then {area_ops.BBOX_CHECK}
        when isnan(voxel_size_m) or voxel_size_m <= 0 then {area_ops.RESOLUTION_CHECK}
        when m2 > max_area_m2 then {area_ops.AREA_CHECK} end as stage
      from area a join sized s on s.area_id = a.area_id)
    select area_id, stage, case stage when {area_ops.BBOX_CHECK} then '{area_ops.BAD_BBOX}'
      when {area_ops.RESOLUTION_CHECK} then '{area_ops.BAD_RESOLUTION}' else '{area_ops.AREA_OVER_BUDGET}' end as message
    from staged where stage is not null""",
    "input_gates": f"""with c as ({named(derived.CONFIGURED_SQL)}),
      cited as (select area_id from ({named(derived.SUPPLIER_SOURCES_SQL)}) as s
        union select area_id from ({named(derived.CITATIONS_SQL)}) as t)
    select area_id, {area_ops.INPUT_CHECK} as stage, {area_ops.REPEATED_AREA} as code, '{area_ops.AREA_TWICE}' as message
      from c group by area_id having count(*) > 1
    union all select area_id, {area_ops.INPUT_CHECK}, {area_ops.UNKNOWN_AREA}, '{area_ops.NO_SUCH_AREA}'
      from cited where area_id not in (select area_id from c)""",
    "pair_areas": f"""select o.pos, s.area_id from ({named(derived.ORDER_BOXES_SQL)}) as o join ({named(derived.SUPPLIER_BOXES_SQL)}) as s
      on o.west <= s.east and o.east >= s.west and o.south <= s.north and o.north >= s.south""",
    "line_clip": f"""with {LINES} select pos, cast(n - 1 as integer) as i,
      {tidy('least(px, qx)')} as west, {tidy('greatest(px, qx)')} as east,
      {tidy('least(pz, qz)')} as south, {tidy('greatest(pz, qz)')} as north
    from clipped c where exists (select 1 from point p where p.pos = c.pos and p.n = 2)""",
    "in_area": f"""with {FOOTPRINTS}, {_CLIPPED_EDGES}, hit as (select distinct pos from meets where gone = 0 and t0 <= t1)
    select f.area_id, count(hit.pos) as accepted, count(*) - count(hit.pos) as dropped
    from foot f left join hit on hit.pos = f.pos group by f.area_id""",
    "export_features": f"""with {FOOTPRINTS}, {_CLIPPED_EDGES}, hit as (select distinct pos from meets where gone = 0 and t0 <= t1),
    {_clipped_rings()}
    select area_id, pos, concat('b', cast(pos as varchar)) as feature,
      cast(dense_rank() over (partition by pos order by ring) - 1 as integer) as ring, cast(i as integer) as i,
      {tidy('x')} as x, {tidy('z')} as z from closed""",
    "validity": VALIDITY,
    "validity_large": VALIDITY_LARGE,
    "resolve_evidence": EVIDENCE,
    "issues": ISSUES,
    "registry_last_wins": REGISTRY,
    "source_gate": f"""select area_id, '{area_ops.BAD_SOURCE}' as message, count(*) as sources from ({REGISTRY}) as r
    where not complete group by area_id""",
    "unregistered": f"""select c.area_id, c.pos, c.source_id from ({named(derived.CITATIONS_SQL)}) as c where not exists (
      select 1 from ({named(derived.SUPPLIER_SOURCES_SQL)}) as s where s.area_id = c.area_id and s.id = c.source_id)""",
    "default_ids": f"""select area_id, pos, case when has_id then id else cast(coalesce(sum(case when accepted then 1 else 0 end)
      over (partition by area_id order by pos rows between unbounded preceding and 1 preceding), 0) as varchar) end as feature
    from ({named(derived.NAMELESS_SQL)}) as n""",
    "classify_kinds": f"with {CLASSIFIED} select area_id, pos, kind from classified where kind is not null",
    "skipped_elements": f"with {CLASSIFIED} select area_id, pos, id, reason from kept where reason is not null",
    "osm_geometry": f"""with {CLASSIFIED} select area_id, pos, concat('osm/way/', cast(id as varchar)) as id,
      case when n_vertices = 5 and kind not in ('path', 'attraction') then 'Polygon' else 'LineString' end as geom_type,
      kind, '{config.OSM_SOURCE_ID}' as source_id, tag_building as building, n_vertices as vertices from kept where reason is null""",
    "select_elements": SELECTED,
    "quality_report": REPORT,
    "report_lists": LISTS,
}
