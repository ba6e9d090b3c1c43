"""Shapes that only touch their area, and keys at the ends of their type, against the oracle SQL."""

import glob
import os
import shutil

import numpy as np
import pytest

import __spark_entry__ as entry_module
from lithogrid.functions.geodesy import azimuthal_equidistant
from lithogrid.plans import derived

DATA = "/root/testdata/sf0.001"
#: c_custkey, c_nationkey: a corner or a side of the footprint lies on the area's border.
CUSTOMERS = [(80016, 1), (37670, 1), (53310, 1), (9462, 10), (40730, 10)]
#: o_orderkey, nation, l_linenumber, l_partkey, l_suppkey: lines along the area's border, or cut at a rounding tie.
ITEMS = [
    (40445, 4, 4, 2, 2), (40445, 4, 5, 5, 5), (40445, 4, 5, 10, 0), (40445, 4, 6, 9, 5), (40445, 4, 7, 6, 6),
    (49705, 18, 1, 8, 7), (49705, 18, 2, 5, 7), (49705, 18, 5, 10, 1), (49705, 18, 6, 0, 6), (49705, 18, 6, 8, 5),
    (79267, 13, 3, 0, 0), (79267, 13, 3, 4, 4), (79267, 13, 4, 0, 4), (79267, 13, 5, 3, 7), (79267, 13, 7, 0, 2),
    (340151, 2, 5, 5, 5), (340151, 2, 6, 9, 4), (340151, 2, 6, 9, 7),
]


def compare(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = entry_module.queries()[name](spark, str(data)).toPandas()
    expected = connection.sql(entry_module.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    rows = lambda frame: sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))
    assert rows(found) == rows(expected)


@pytest.fixture(scope="module")
def touching(tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    data = tmp_path_factory.mktemp("touching")
    for name in ("nation", "region", "events", "supplier", "part"):
        shutil.copyfile(f"{DATA}/{name}.parquet", f"{data}/{name}.parquet")
    orders = sorted({(key, 10**6 + nation, nation) for key, nation, *_ in ITEMS})
    nations = sorted({(customer, nation) for _, customer, nation in orders})
    values = lambda rows: ", ".join(map(str, rows))
    tables = {
        "customer": f"""select cast(a as bigint) as c_custkey, cast(b as integer) as c_nationkey, cast(1 as double) as c_acctbal
          from (values {values(CUSTOMERS + nations)}) as t(a, b)""",
        "orders": f"""select cast(a as bigint) as o_orderkey, cast(b as bigint) as o_custkey from (values {values(orders)}) as t(a, b, c)""",
        "lineitem": f"""select cast(a as bigint) as l_orderkey, cast(c as integer) as l_linenumber, cast(d as bigint) as l_partkey,
          cast(e as bigint) as l_suppkey from (values {values(ITEMS)}) as t(a, b, c, d, e)"""}
    for name, sql in tables.items():
        duckdb.connect().execute(f"copy ({sql}) to '{data}/{name}.parquet' (format parquet)")
    return data


@pytest.mark.parametrize("name", ["capsule_cells", "export_features", "in_area", "line_clip", "quality_report", "voxel_counts"])
def test_what_touches_the_area_is_as_in_sql(spark, touching, name):
    compare(spark, touching, name)


def test_projection_is_precise_and_the_same_in_every_batch():
    lon, lat = np.array([0.0005, 5.0005, 179.9]), np.array([0.0, 48.0, -0.3])
    lon0, lat0 = np.array([0.0, 5.0, 0.0]), np.array([0.0, 48.001, 0.0])
    x, z = azimuthal_equidistant(lon, lat, lon0, lat0)
    assert abs(x[0] - 6378137.0 * np.radians(0.0005)) < 1e-12
    for i in range(3):
        one = slice(i, i + 1)
        alone = azimuthal_equidistant(lon[one], lat[one], lon0[one], lat0[one])
        assert (alone[0][0], alone[1][0]) == (x[i], z[i])


def test_evidence_of_any_key_is_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    keys = [None, 0, -1, -15, -9240, -12345, 9240, *range(2**53 - 9, 2**53 + 31), 7 * 10**16 + 1, 2**60 + 3]
    rows = ", ".join(f"({'null' if k is None else k})" for k in keys)
    duckdb.connect().execute(f"copy (select cast(a as bigint) as o_orderkey from (values {rows}) as t(a)) "
                             f"to '{tmp_path}/orders.parquet' (format parquet)")
    compare(spark, tmp_path, "resolve_evidence")


@pytest.mark.parametrize("make", [derived.footprints, derived.lines])
def test_features_are_not_broadcast(touching, spark, make, capsys):
    make(spark, str(touching)).explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "BroadcastHashJoin [nation#" in line]
    assert joins and all("BuildRight" in line for line in joins)
