"""Token-id files of a corpus in ascending order of its ids, and what is read back from them.

Documents are dealt by range of (doc_id, digest of the text), so that neither
null nor repeated ids make a task large, sorted within each range, encoded and
written file by file (``range_coder``). A file has whole documents and about
``file_ids`` ids. Files are rows of a Parquet table, which any store that Spark
writes can hold: ``part`` and ``file`` order them, ``data`` is the file.

Null text counts as empty and still has its end id. Null ids come first, equal
ids in order of their texts' digests. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithogrid.llm import range_coder
from lithogrid.llm.common import Shared, table
from lithogrid.llm.tokens import encoder, tokenizer_path

END = 1
FILE_IDS = 1 << 23

_FILES = "part int, file int, n_docs long, n_ids long, data binary"
_DOCS = "part int, file int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(path: str, end: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            kind = encoder(path).kind
            ids = np.frombuffer(b"".join(held), kind).astype(np.int64)
            lengths = np.array([len(x) // kind.itemsize for x in held])
            data = range_coder.write_file(names, lengths, ids)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "file": file, "n_docs": len(names), "n_ids": len(ids), "data": data}],
                pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                           ("data", pa.binary())]))

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for name, ids in zip(doc_ids, encoder(path).encode((t.as_py() for t in batch.column("text")), end)):
                held.append(ids)
                names.append(name)
                size += len(ids) // encoder(path).kind.itemsize
                if size >= file_ids:
                    yield close()
                    file, held, names, size = file + 1, [], [], 0
        if names:
            yield close()

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files into the shared folder and return the table of them."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    ordered = rows.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    files = ordered.select("doc_id", "text").mapInArrow(_write(tokenizer, end, file_ids), _FILES)
    return Shared(spark).save(files, "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, file, data in zip(*(batch.column(c) for c in ("part", "file", "data"))):
            names, lengths, ids = range_coder.read_file(data.as_py())
            starts = np.cumsum(lengths) - lengths
            wide = ids.astype("<u4")
            digests = [zlib.crc32(wide[s:s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]
            count = len(names)
            yield pa.RecordBatch.from_arrays([
                pa.array([part.as_py()] * count, pa.int32()), pa.array([file.as_py()] * count, pa.int32()),
                pa.array(names, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(digests, pa.int64()),
            ], ["part", "file", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start among all ids, n_tokens, ids_crc32."""
    sizes = files.select("part", "file", "n_ids")
    # sums over parts, of which there are as many as write tasks, then over the files of a part
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(
        "part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    first = sizes.withColumn("within", within).join(parts, "part").select(
        "part", "file", (F.col("before") + F.col("within")).alias("first"))
    docs = files.select("part", "file", "data").mapInArrow(_read, _DOCS)
    return docs.join(first, ["part", "file"]).select(
        "doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
