"""Packing of token ids into sequences: first-fit decreasing over a tournament tree, in random groups.

Documents are dealt at random into groups of about ``group_docs``. Each group
packs alone: whole multiples of the sequence length become sequences of their
own, what is left of each document goes, longest first, into the first
sequence with room. The tree holds the room of every sequence and its inner
nodes the larger room below, so the first fit is found in one descent.

Null text counts as empty; an empty document still has its end id. Repeated
rows are packed as often as they occur, also without an id: groups are drawn by
row, so no id makes a group large. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.llm.common import table
from lithogrid.llm.tokens import encoder, tokenizer_path

LENGTH = 1024
GROUP_DOCS = 2048
END = 0
_BY_BYTES = 1 << 24

PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "padded_length long, ids binary")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, of which none exceeds the capacity."""
    count = len(sizes)
    leaves = 1 << max(0, (count - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for at in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[at]), 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        bins[at], offsets[at] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def _tokenize(path: str, end: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(["grp", "row", "doc_id"])
            held, size, at = [], 0, 0
            for ids in encoder(path).encode((t.as_py() for t in batch.column("text")), end):
                held.append(ids)
                size += len(ids)
                if size >= _BY_BYTES:
                    yield _rows(keys.slice(at, len(held)), held)
                    held, size, at = [], 0, at + len(held)
            yield _rows(keys.slice(at, len(held)), held)

    return tokenize


def _rows(keys: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys.columns, pa.array(ids, pa.binary())], ["grp", "row", "doc_id", "ids"])


def _pack(path: str, length: int):
    def pack(rows: pa.Table) -> pa.Table:
        kind = encoder(path).kind
        rows = rows.sort_by("row")
        group = rows.column("grp")[0].as_py()
        ids = [np.frombuffer(x, kind) for x in rows.column("ids").to_pylist()]
        tokens = np.array([len(x) for x in ids], np.int64)
        whole, left = tokens // length, tokens % length
        some = np.flatnonzero(left)
        bins, offsets = first_fit_decreasing(left[some], length)
        full = np.concatenate([np.repeat(np.arange(len(ids)), whole), some])
        start = np.concatenate([*(np.arange(n) * length for n in whole.tolist()), whole[some] * length]).astype(np.int64)
        size = np.concatenate([np.full(int(whole.sum()), length), left[some]]).astype(np.int64)
        place = np.concatenate([np.arange(int(whole.sum())), bins + int(whole.sum())])
        offset = np.concatenate([np.zeros(int(whole.sum()), np.int64), offsets])
        filled = np.bincount(place, size).astype(np.int64) if len(place) else np.zeros(0, np.int64)
        padded = np.where(filled & (filled - 1) == 0, filled, length)
        out = [ids[d][s:s + n].astype("<u4").tobytes() for d, s, n in zip(full.tolist(), start.tolist(), size.tolist())]
        return pa.table({
            "doc_id": rows.column("doc_id").take(pa.array(full)), "start": start, "length": size,
            "doc_tokens": tokens[full], "sequence_id": (group << 32) + place, "offset": offset,
            "padded_length": padded[place], "ids": pa.array(out, pa.binary())})

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END,
                   group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """One row per piece; ``ids`` are its ids as little-endian unsigned 32-bit numbers.

    The ids of a document with its end id are shuffled once, to the document's
    group; a sequence is its pieces in order of ``offset`` and then padding up
    to ``padded_length``, which is the filled length where that is a power of two.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    ids = dealt.mapInArrow(_tokenize(tokenizer, end), "grp long, row long, doc_id long, ids binary")
    return ids.groupBy("grp").applyInArrow(_pack(tokenizer, length), PIECES)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return with_digest(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")
