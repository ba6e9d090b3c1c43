"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Rows without an id, repeated rows, null and empty texts and empty tables take
the defined results of the stages' operators. All stages but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithogrid.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from lithogrid.llm.common import Shared, table
from lithogrid.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), name)
    return docs
