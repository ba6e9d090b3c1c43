"""Language-model scores by cross-entropy difference.

Two bigram models, of the target texts (documents labelled as good) and of the
background (all documents), score each document: the mean over its words of
the loss under the target less the loss under the background. Lower is
closer to the target.

The models match: they share one vocabulary, all words of the corpus, one
smoothing, and the background's counts are scaled to the target's mass. Words
and word pairs are counted by 64-bit hashes, every one of them, so nothing is
cut and unrelated pairs do not share counts. A document's own counts are taken
out before it is scored, so target documents gain nothing from having been counted.

The documents lie in blocks of at most ``BLOCK_BYTES`` of text. Each block's
distinct n-grams with their counts go to the part that their hash names; a part
adds the counts of all blocks and answers each block how often its n-grams occur
elsewhere: a bit for each, in the order in which the block sent them, and counts
where the bit is set, but no keys. A block counts its texts again, which gives the
same order, and is scored from its own counts and the answers. A common n-gram is
one entry for each block, however often it occurs, so no part is hot.

The probability of a word after another mixes the pair's share with the word's
share, and that with a uniform one: p1(w) = (c(w) + A) / (N + A * V),
p2(w | v) = (c(v, w) + M * p1(w)) / (c(v) + M), where V is the number of distinct
words, 2 ** WORD_BITS at least.

Null and empty texts have no words and the score 0. A document is a target if
any label row of its id says so; null ids never are. Repeated rows score
alike. Without a target document, all losses are those of the smoothing alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.llm.common import Shared, per_worker, table

#: The uniform share counts 2 ** WORD_BITS words at least.
WORD_BITS = 18
#: Bits of the hashes of words and pairs.
PAIR_BITS = 64
ALPHA = 0.1
MIX = 4.0
MAX_WORDS = 400_000
#: Text that is counted and scored together.
BLOCK_BYTES = 16 << 20
#: Parts that the n-grams are dealt to, more if a part would serve over PART_BYTES of text.
PARTS = 128
PART_BYTES = 16 << 20
#: What a row without text counts for.
_ROW_BYTES = 64

_TABLE = bytes((i + 32 if 65 <= i <= 90 else i if chr(i).isalnum() or i >= 128 else 32) for i in range(256))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Words to 64-bit hashes; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word, digest_size=PAIR_BITS // 8).digest(), "little")
        return found


def hashes_of(text: str | None, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of the pairs of neighbours."""
    words = (text or "").encode().translate(_TABLE).split()
    hashed = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return hashed, hashed[:-1] * _FIRST + hashed[1:] * _SECOND


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their block."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for length in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
            if size and size + length > BLOCK_BYTES:
                block, size = block + 1, 0
            size += length + _ROW_BYTES
            numbers.append(block)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "block"])


def counted(found: list[np.ndarray], flags: list[bool]) -> np.ndarray:
    """Rows of keys in order, background counts and target counts of the texts' n-grams."""
    if not found:
        return np.zeros((3, 0), np.uint64)
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    whole = np.zeros((3, len(keys)), np.uint64)
    whole[0], whole[1] = keys, counts
    target = [f for f, flag in zip(found, flags) if flag]
    if target:
        keys, counts = np.unique(np.concatenate(target), return_counts=True)
        whole[2, np.searchsorted(whole[0], keys)] = counts
    return whole


def _planes(values: np.ndarray) -> bytes:
    """As many bytes of each value as the largest needs, byte by byte, so that zeros lie together for Spark's compression."""
    width = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + wide[:, :width].T.tobytes()


def _values(value: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The n values of the planes at a place, and where they end."""
    width, at = value[at], at + 1
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(value, np.uint8, width * n, at).reshape(width, n).T
    return wide.view("<u8")[:, 0], at + width * n


def _pack(counts: np.ndarray) -> bytes:
    """A cell: how many n-grams, their keys as differences, and their counts."""
    keys = np.diff(counts[0], prepend=np.uint64(0))
    return struct.pack("<Q", len(keys)) + b"".join(map(_planes, (keys, counts[1], counts[2])))


def _unpack(value: bytes) -> np.ndarray:
    if not value:
        return np.zeros((3, 0), np.uint64)
    n, at = struct.unpack_from("<Q", value)[0], 8
    counts = np.empty((3, n), np.uint64)
    for k in range(3):
        counts[k], at = _values(value, at, n)
    counts[0] = np.cumsum(counts[0], dtype=np.uint64)
    return counts


def _pack_answer(elsewhere: np.ndarray) -> bytes:
    """Both counts of a cell's n-grams in other blocks, in the cell's order; a bit tells which occur there."""
    found = elsewhere[0] > 0
    return struct.pack("<Q", len(found)) + np.packbits(found).tobytes() + _planes(elsewhere[0, found]) + _planes(elsewhere[1, found])


def _unpack_answer(value: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of the cell, places of those that occur elsewhere, both counts of these)."""
    n = struct.unpack_from("<Q", value)[0]
    bits = np.frombuffer(value, np.uint8, -(-n // 8), 8)
    places = np.flatnonzero(np.unpackbits(bits, count=n))
    background, at = _values(value, 8 + len(bits), len(places))
    target, _ = _values(value, at, len(places))
    return n, places, background, target


def _cells(parts: int):
    """A task's n-grams by block and part: the words and the pairs, packed with their counts."""
    def dealt(counts: np.ndarray) -> dict[int, bytes]:
        part = ((counts[0] >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)  # parts are ranges of keys
        own, first = np.unique(part, return_index=True)
        ends = [*first[1:].tolist(), len(part)]
        return {p: _pack(counts[:, a:z]) for p, a, z in zip(own.tolist(), first.tolist(), ends)}

    def settle(block: int, words: list, pairs: list, flags: list) -> Iterator[pa.RecordBatch]:
        one, two = dealt(counted(words, flags)), dealt(counted(pairs, flags))
        own = sorted(one.keys() | two.keys())
        if own:
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([block] * len(own), pa.int64()),
                 pa.array([one.get(p, b"") for p in own], pa.binary()), pa.array([two.get(p, b"") for p in own], pa.binary())],
                ["part", "block", "words", "pairs"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("word-hashes", 0, _Hashes)
        at, words, pairs, flags = None, [], [], []
        for batch in batches:
            for block, text, target in zip(batch.column("block").to_pylist(), batch.column("text"),
                                           batch.column("target").to_pylist()):
                if block != at:
                    yield from settle(at, words, pairs, flags)
                    at, words, pairs, flags = block, [], [], []
                one, two = hashes_of(text.as_py(), hashes)
                words.append(one)
                pairs.append(two)
                flags.append(bool(target))
        yield from settle(at, words, pairs, flags)

    return cells


def _answer(cells: pa.Table) -> pa.Table:
    """For the blocks of a part, how often each of their n-grams occurs in other blocks.

    The first row has the part's sums over words.
    """
    columns, sums = {"part": cells["part"], "block": cells["block"]}, (0, 0, 0)
    for name in ("words", "pairs"):
        own = [_unpack(v) for v in cells[name].to_pylist()]
        distinct = np.unique(np.concatenate([c[0] for c in own]))
        whole = np.zeros((2, len(distinct)), np.uint64)
        for keys, *counts in own:  # a cell has a key once
            whole[:, np.searchsorted(distinct, keys)] += counts
        if name == "words":
            sums = int(whole[0].sum()), int(whole[1].sum()), len(distinct)
        columns[name] = pa.array(
            [_pack_answer(whole[:, np.searchsorted(distinct, c[0])] - c[1:]) for c in own], pa.binary())
    for name, n in zip(("total", "target_total", "distinct"), sums):
        columns[name] = pa.array([n] + [0] * (cells.num_rows - 1), pa.int64())
    return pa.table(columns)


class Models:
    """Counts of both models for the n-grams of a block; answers: those of the parts, in their order, to words and pairs."""

    def __init__(self, own: list[np.ndarray], answers: list[list[bytes]], totals: tuple[int, int], distinct: int):
        self.counts = []
        for counts, values in zip(own, answers):
            at = 0
            for n, places, *found in map(_unpack_answer, values):
                counts[1:, at + places] += found
                at += n
            if at != counts.shape[1]:
                raise ValueError("the answers are not those of the block's n-grams")
            self.counts.append((counts[0], *counts[1:].view(np.int64)))
        self.totals = totals
        self.vocabulary = max(distinct, 1 << WORD_BITS)
        #: Scale of the counts; the background has the target's mass.
        self.scale = (totals[1] / totals[0] if totals[0] and totals[1] else 1.0, 1.0)

    def losses(self, words: np.ndarray, pairs: np.ndarray, own: bool) -> tuple[float, float]:
        """Mean loss of the words under target and background; own: the text is counted in the target."""
        if not len(words):
            return 0.0, 0.0
        distinct, at = np.unique(words, return_inverse=True)
        mine = np.bincount(at)
        distinct_pairs, at_pair = np.unique(pairs, return_inverse=True)
        mine_pairs = np.bincount(at_pair, minlength=len(distinct_pairs))
        (known, *singles), (known_pairs, *doubles) = self.counts
        place, place_pair = np.searchsorted(known, distinct), np.searchsorted(known_pairs, distinct_pairs)
        found = []
        for kind in (1, 0):
            scale = self.scale[kind]
            counted = own or kind == 0
            single = np.maximum(singles[kind][place] - mine * counted, 0) * scale
            pair = np.maximum(doubles[kind][place_pair] - mine_pairs * counted, 0) * scale
            total = max(self.totals[kind] - len(words) * counted, 0) * scale
            p1 = ((single + ALPHA) / (total + ALPHA * self.vocabulary))[at]
            p2 = (pair[at_pair] + MIX * p1[1:]) / (np.maximum(single[at[:-1]], pair[at_pair]) + MIX)
            found.append(float(-(np.log(p1[0]) + np.log(p2).sum()) / len(words)))
        return found[0], found[1]


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target): whether a label of the document's id is good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("good"), F.lit(0).cast("bigint").alias("at")).distinct()
    # rows without an id are dealt out by their number instead of meeting in one task
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 1 + F.monotonically_increasing_id()).otherwise(
        F.lit(0)).alias("deal"))
    # the same join at every size: labels grow with the documents
    return rows.join(good.hint("merge"), (F.col("doc_id") == F.col("good")) & (F.col("deal") == F.col("at")), "left").select(
        "doc_id", "text", F.col("good").isNotNull().alias("target"))


def lm_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, target, n_words, target_loss, background_loss, score."""
    shared = Shared(docs.sparkSession)
    # the flags are joined once, and both passes over the texts read the result
    rows = shared.save(with_target(docs, labels).mapInArrow(
        _in_blocks, "doc_id long, text string, target boolean, block long"), "texts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = rows.select("text", "target", "block").mapInArrow(
        _cells(max(PARTS, -(-size // PART_BYTES))), "part int, block long, words binary, pairs binary")
    answers = shared.save(cells.groupBy("part").applyInArrow(
        _answer, "part int, block long, words binary, pairs binary, total long, target_total long, distinct long"), "answers")
    *totals, distinct = (n or 0 for n in answers.agg(F.sum("total"), F.sum("target_total"), F.sum("distinct")).first())

    def score(texts: pa.Table, seen: pa.Table) -> pa.Table:
        hashes = per_worker("word-hashes", 0, _Hashes)
        hashed = [hashes_of(t.as_py(), hashes) for t in texts["text"]]
        targets = texts["target"].to_pylist()
        own = [counted([h[k] for h in hashed], targets) for k in (0, 1)]
        seen = seen.sort_by("part")  # parts are ranges of keys
        found = Models(own, [seen["words"].to_pylist(), seen["pairs"].to_pylist()], totals, distinct)
        out = [(len(words), *found.losses(words, pairs, target)) for (words, pairs), target in zip(hashed, targets)]
        n, *losses = zip(*out) if out else ((), (), ())
        return pa.table({"doc_id": texts["doc_id"], "target": texts["target"], "n_words": pa.array(n, pa.int64()),
                         "target_loss": pa.array(losses[0], pa.float64()), "background_loss": pa.array(losses[1], pa.float64())})

    scored = rows.groupBy("block").cogroup(answers.select("block", "part", "words", "pairs").groupBy("block")).applyInArrow(
        score, "doc_id long, target boolean, n_words long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
