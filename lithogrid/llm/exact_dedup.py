"""Exact deduplication by skew-safe combining, with DataFrame operations only.

Partial aggregation deduplicates each task's rows, salted digest groups merge
what the tasks found, and the salts' winners are combined by digest. Every
stage groups by the whole normalised text beside its digest, so texts with the
same digest never merge. The map of documents to classes then needs digests
only, but for digests that several texts share.

Null text counts as empty. Null ids come after all others; a group without any
id has a null ``keep_id``. Rows that repeat an id with an equal text share
their result; ``keep_first`` leaves one of them. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.llm.common import Shared, join_by_size, table

SALTS = 16


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _contents(rows: DataFrame) -> DataFrame:
    """One row for each text: digest, norm, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("bigint"))
    salted = rows.withColumn("salt", salt).groupBy("digest", "salt", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.repartition("digest").groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_classes(docs: DataFrame, digest=sha256) -> tuple[DataFrame, DataFrame, int]:
    """Classes (digest, norm, keep_id, group_size), ``docs`` with digest and norm, and the number of rows.

    ``norm`` of a class is null unless several texts share the digest.
    """
    shared = Shared(docs.sparkSession)
    rows = docs.withColumn("norm", normalised()).withColumn("digest", digest(F.col("norm")))
    narrow = rows.select("doc_id", "digest", "norm")
    classes = shared.save(_contents(narrow).drop("norm"), "classes")
    digests = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("rows"))
    most, total = digests.agg(F.coalesce(F.max("texts"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if most <= 1:
        classes = classes.withColumn("norm", F.lit(None).cast("string"))
    else:
        clashing = shared.save(digests.filter("texts > 1").select("digest"), "clashing")
        told = _contents(narrow.join(clashing, "digest", "left_semi"))
        alone = classes.join(clashing, "digest", "left_anti").withColumn("norm", F.lit(None).cast("string"))
        classes = shared.save(alone.unionByName(told), "told")
    return classes, rows, total


def with_classes(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Add keep_id and group_size to rows that have a digest."""
    plain = classes.filter("norm IS NULL").select("digest", "keep_id", "group_size")
    told = classes.filter("norm IS NOT NULL")
    if told.isEmpty():
        return join_by_size(rows.drop("norm"), plain, "digest", "group_size", total, F.col("doc_id"))
    # a shared digest is followed by the text itself
    keys = told.select("digest").distinct().withColumn("_shared", F.lit(True))
    told_tag = F.concat_ws(":", "digest", "norm")
    tagged = rows.join(keys, "digest", "left").withColumn(
        "tag", F.when(F.col("_shared"), told_tag).otherwise(F.col("digest")))
    small = plain.select(F.col("digest").alias("tag"), "keep_id", "group_size").unionByName(
        told.select(told_tag.alias("tag"), "keep_id", "group_size"))
    return join_by_size(tagged.drop("norm", "_shared"), small, "tag", "group_size", total, F.col("doc_id")).drop("tag")


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    classes, rows, total = exact_classes(docs.select("doc_id", "text"), digest)
    marked = with_classes(rows.select("doc_id", "digest", "norm"), classes, total)
    return marked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; one of rows that repeat both id and text."""
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    classes, rows, total = exact_classes(packed)
    kept = with_classes(rows.drop("text"), classes, total).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id,
  min(doc_id) over (partition by norm) as keep_id,
  count(*) over (partition by norm) as group_size,
  coalesce(doc_id = min(doc_id) over (partition by norm), true) as kept,
  sha256(norm) as text_sha256
from n
"""
