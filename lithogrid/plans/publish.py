"""Sinks: voxels, clipped features, issues, reports, checksums."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lithogrid.operators import raster
from lithogrid.operators.lookup import lookup
from lithogrid.plans.build import BuildResult, GateError
from lithogrid.plans.workspace import delete, exists, move

ROWS_PER_FILE = 4_000_000
OPEN_AREAS_PER_TASK = 64
VOXEL = ["x", "y", "z", "kind", "feature", "source"]


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def balanced(spans: DataFrame, counts: DataFrame, rows_per_file: int = ROWS_PER_FILE,
             max_tasks: int = 2**31 - 1) -> DataFrame:
    """Spread spans so that each task writes one well-filled file of an area.

    An area gets as many shares as its voxels fill files, so a hot area is many
    tasks and a small one a single file. The number of tasks is stated, because
    spans are far smaller than the voxels they turn into and would be merged
    by their size otherwise. Spans of one column and feature stay in order of
    feature, x and z.
    """
    files = F.ceil(F.col("voxel_records") / rows_per_file)
    total = counts.agg(F.sum(files)).first()[0] or 1
    tasks = int(max(1, min(total, max_tasks)))
    shares = counts.select(
        "area_id", F.greatest(F.lit(1), files).alias("_shares"))
    shared = lookup(spans, shares, ["area_id"], "inner", spread_by=("pos", "x"))
    tall = shared.withColumn("_layer", F.explode(F.expr(f"sequence(y0, y1 - 1, {rows_per_file})")))
    cut = tall.withColumn("y1", F.expr(f"least(y1, _layer + {rows_per_file})")).withColumn(
        "y0", F.col("_layer")).drop("_layer")
    placed = cut.withColumn("_share", F.pmod(F.xxhash64("pos", "x", "y0"), F.col("_shares")))
    return placed.repartition(tasks, "area_id", "_share").sortWithinPartitions("area_id", "pos", "x", "z0").drop(
        "_share", "_shares")


def in_order(spans: DataFrame, counts: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Spans in order of area, feature, x and z over all tasks, as many as their voxels fill files.

    Tasks hold ranges of that order, so the files of an area, by name, are in order of feature, x, z and y.
    """
    total = counts.agg(F.sum(F.ceil(F.col("voxel_records") / rows_per_file))).first()[0] or 1
    keys = ["area_id", "pos", "x", "z0"]
    return spans.repartitionByRange(int(max(1, min(total, 2**31 - 1))), *keys).sortWithinPartitions(*keys)


def _together(rows: DataFrame) -> DataFrame:
    """Bring areas together before ``partitionBy``; AQE splits areas that are too large for a task."""
    return rows.hint("rebalance", "area_id")


def publish(result: BuildResult, path: str, voxel_format: str = "parquet",
            rows_per_file: int = ROWS_PER_FILE, ordered: bool = False) -> dict:
    """Write all artifacts of a build that passed its gates, the report last.

    Voxels are in order within each file; ``ordered`` also puts the files of an
    area in order, at the price of a sample of the spans and less even files.

    Everything goes to a folder beside ``path`` that is moved there when it is
    whole and deleted when a write fails, so no part of a map is ever seen. The
    digest is taken while the voxels are written and does not depend on order.
    The strict gate comes after the artifacts, so that a failed run can be
    inspected. The build's stage tables are deleted at the end.
    """
    spark = result.spans.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        seen, failed = _write(result, staging, voxel_format, rows_per_file, ordered)
        move(spark, staging, path)
    except BaseException:
        delete(spark, staging)
        raise
    result.work.remove()
    if failed:
        raise GateError("Strict accuracy gate failed; inspect quality-report")
    return {"voxel_records": seen["rows"], "digest": seen["digest"] or 0}


def _write(result: BuildResult, path: str, voxel_format: str, rows_per_file: int, ordered: bool = False) -> tuple[dict, bool]:
    spark = result.spans.sparkSession
    watch = Observation()
    spans = (in_order if ordered else balanced)(result.spans.filter("y0 < y1"), result.voxel_counts, rows_per_file)
    voxels = raster.extrude(spans).observe(
        watch, F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64("area_id", *VOXEL)).alias("digest"))
    with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_AREAS_PER_TASK)):
        voxels.write.partitionBy("area_id").format(voxel_format).option(
            "maxRecordsPerFile", rows_per_file).save(f"{path}/voxels")
    seen = watch.get
    _together(result.local_features.select("area_id", F.col("feature_json").alias("value"))).write.partitionBy(
        "area_id").text(f"{path}/features-local")
    _together(result.issues).write.partitionBy("area_id").json(f"{path}/issues")
    sums = result.work.save(checksums(spark, f"{path}/voxels"), "checksums")
    sums.write.json(f"{path}/checksums")
    _together(result.list_pieces).write.partitionBy("area_id").json(f"{path}/report-lists")
    headers = result.headers.join(area_checksums(sums), "area_id", "left")
    headers.write.json(f"{path}/quality-report")
    written = spark.read.schema(headers.schema).json(f"{path}/quality-report")
    return seen, not written.filter("strict_failed").isEmpty()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every voxel file, by its path below ``path``; files are bounded by the rows they hold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_extract("path", r"/(area_id=[^/]*/[^/]*)$", 1)
    return files.select(below.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def area_checksums(sums: DataFrame) -> DataFrame:
    """One checksum per area: SHA-256 over the sorted checksums of its files."""
    area = F.url_decode(F.regexp_replace(F.regexp_extract("file", r"^area_id=([^/]*)/", 1), r"\+", "%2B"))
    return sums.groupBy(area.alias("area_id")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("voxels_sha256"),
        F.count(F.lit(1)).alias("voxel_files"))
