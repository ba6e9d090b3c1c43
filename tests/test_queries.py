"""Catalogue checks; the quick queries also against their oracle SQL."""

import glob
import os

import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
QUICK = ["area_gates", "input_gates", "voxel_budget", "classify_kinds", "default_ids", "osm_geometry", "pair_areas", "project_vertices",
         "registry_last_wins", "resolve_evidence", "skipped_elements", "unregistered", "validity", "report_header", "split_collections"]


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = entry_module.queries()[name](spark, DATA)
    expected = connection.sql(entry_module.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)

    def rows(frame):
        return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))

    assert rows(found.toPandas()) == rows(expected.df())
