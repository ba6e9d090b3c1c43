"""SimHash near-duplicates by anchor-point covering.

A fingerprint takes 64 majority bits of the XXH64 values of a text's 3-word
shingles. Two fingerprints that differ in at most two bits differ in at most
one bit of their upper or of their lower half. For each half the anchors are
the codewords of the perfect Hamming code of 31 bits (covering radius 1; the
half's last bit is left out), and a fingerprint is copied to every anchor
within covering radius plus threshold, 1 + 1: 16 anchors, or one for a codeword.
Linked fingerprints meet at the anchor nearest to one of them, where they are compared.

Only distinct fingerprints are copied. An anchor with more than ``limit`` of
them is not held: its rows stream on to a second pass, keyed by six of the
eight nibbles of the other half, of which two differing bits leave six alone.
Such a key holds at most 994 * 256 fingerprints whatever the input. A task
passes on a forest of the links that it found, not all pairs.

Null or wordless text has the fingerprint zero, linked like any other. Rows
that repeat an id count as one document only where their fingerprints link;
ids are compared at the end, nulls after all others. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithogrid.llm.common import Shared, join_by_size, table
from lithogrid.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints at one anchor that are compared in the first pass.
LIMIT = 1024
_ROWS = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, _ROWS):
        some = words[start:start + _ROWS + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(SHINGLE)))) if count > 1 or len(words) == SHINGLE else [
            b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield pd.Series([fingerprint(t) for t in some], dtype="int64")


def _syndrome(bits: np.ndarray) -> np.ndarray:
    """Exclusive or of the positions 1 to 31 of the set bits."""
    found = np.zeros(len(bits), np.uint32)
    for at in range(31):
        found ^= np.where(bits >> np.uint32(at) & np.uint32(1), np.uint32(at + 1), np.uint32(0))
    return found


def _pairs() -> np.ndarray:
    """For each syndrome the 15 two-bit masks that lead to a codeword."""
    masks = np.zeros((32, 15), np.uint32)
    for s in range(1, 32):
        masks[s] = [1 << (i - 1) | 1 << (j - 1) for i, j in combinations(range(1, 32), 2) if i ^ j == s]
    return masks


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every anchor of both halves within distance 2; bit 31 of an anchor names the half."""
    pairs, keys, values = _pairs(), [], []
    for half in (0, 1):
        bits = (fps.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = _syndrome(bits)
        nearest = np.where(s > 0, bits ^ (np.uint32(1) << (np.maximum(s, 1) - np.uint32(1))), bits)
        far = s > 0
        around = (bits[far, None] ^ pairs[s[far]]).ravel()
        keys.append(np.concatenate([nearest, around]).astype(np.int64) | half << 31)
        values.append(np.concatenate([fps, np.repeat(fps[far], 15)]))
    return np.concatenate(keys), np.concatenate(values)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for at in range(0, len(fps), _ROWS):
            key, fp = anchors(fps[at:at + _ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros_like(key)), pa.array(fp)], ["key", "sub", "fp"])


_NIBBLES = [sum(0xF << 4 * i for i in kept) for kept in combinations(range(8), 6)]


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key the rows of hot anchors by six of eight nibbles of the other half."""
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        other = (fp.view(np.uint64) >> np.where(key >> 31 & 1, 0, 32).astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for i, mask in enumerate(_NIBBLES):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(other & mask | i << 32), pa.array(fp)], ["key", "sub", "fp"])


def _contract(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links a-b; every root is the smallest of its tree."""
    while True:
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            return root
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(nearer := root[root], root):
            root = nearer


def _links(run: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within runs of equal keys. run: number of each row's run, ascending."""
    rest = np.searchsorted(run, run, "right") - np.arange(len(run))  # rows from here to the end of the run
    root, bits = np.arange(len(run)), fp.view(np.uint64)
    waiting, held = [], 0
    active, apart = np.flatnonzero(rest > 1), 1
    while len(active):
        near = active[np.bitwise_count(bits[active] ^ bits[active + apart]) <= MAX_BITS]
        near = near[root[near] != root[near + apart]]
        if len(near):
            waiting.append((near, near + apart))
            held += len(near)
        if held > 1 << 18:
            root, waiting, held = _contract(root, *map(np.concatenate, zip(*waiting))), [], 0
        apart += 1
        active = active[rest[active] > apart]
    if waiting:
        root = _contract(root, *map(np.concatenate, zip(*waiting)))
    tied = np.flatnonzero(root != np.arange(len(root)))
    return fp[tied], fp[root[tied]]


def _compare(limit: int | None):
    """Links of sorted (key, sub, fp) rows; rows of runs over the limit come back as (fp, null, key)."""

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)], ["a", "b", "key"])

    def judge(key: np.ndarray, sub: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))])
        size = np.bincount(run)[run]
        if limit is not None and (size > limit).any():
            hot = size > limit
            yield out(fp[hot], None, key[hot])
            run, fp, size = run[~hot], fp[~hot], size[~hot]
        a, b = _links(run[size > 1], fp[size > 1])
        if len(a):
            yield out(a, b, None)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        hot = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "sub", "fp")]
            if hot is not None:
                more = int(np.searchsorted(new[0], hot, "right"))
                if more:
                    yield out(new[2][:more], None, new[0][:more])
                    new = [x[more:] for x in new]
                if not len(new[0]):
                    continue
                hot = None
            rows = [np.concatenate(x) for x in zip(held, new)]
            if not len(rows[0]):
                continue
            changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            last = int(changes[-1]) + 1 if len(changes) else 0
            yield from judge(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
            if limit is not None and len(held[0]) > limit:
                yield out(held[2], None, held[0])
                hot, held = held[0][0], [np.empty(0, np.int64)] * 3
        yield from judge(*held)

    return compare


def near_links(classes: DataFrame, shared: Shared, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``classes.fp`` whose transitive closure is that of all links."""
    rows, found = "key long, sub long, fp long", "a long, b long, key long"
    copies = classes.select("fp").mapInArrow(_replicate, rows)
    first = shared.save(copies.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
        _compare(limit), found), "first")
    hot = first.filter("b IS NULL").select("key", F.col("a").alias("fp"))
    second = hot.mapInArrow(_divide, rows).repartition("key", "sub").sortWithinPartitions(
        "key", "sub", "fp").mapInArrow(_compare(None), found)
    return first.filter("b IS NOT NULL").select("a", "b").unionByName(second.select("a", "b"))


def near_classes(fps: DataFrame, shared: Shared, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """(fp, n, root, component_id) for each distinct fingerprint of ``fps`` (doc_id, fp), and the number of rows."""
    classes = shared.save(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(near_links(classes, shared, limit), shared)
    placed = shared.save(classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "id", "n", F.coalesce("root", "fp").alias("root")), "placed")
    least = shared.save(placed.groupBy("root").agg(
        F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    named = join_by_size(placed, least, "root", "members", total, F.col("fp"))
    return shared.save(named.select("fp", "n", "root", "component_id"), "named"), total


def simhash_dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    shared = Shared(docs.sparkSession)
    fps = shared.save(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    named, total = near_classes(fps, shared, limit)
    return join_by_size(fps, named, "fp", "n", total, F.col("doc_id")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The document with the smallest id of each component, with all its columns."""
    shared = Shared(docs.sparkSession)
    fps = shared.save(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    named, total = near_classes(fps, shared, limit)
    most = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    packed = docs.select(F.struct("*").alias("row"), "doc_id", fingerprints("text").alias("fp"))
    kept = join_by_size(packed, named, "fp", "n", total, F.col("doc_id")).filter(
        F.col("doc_id").eqNullSafe(F.col("component_id")))
    if most > 1:  # rows of a component may repeat its id, or have none
        kept = kept.dropDuplicates(["doc_id", "root"])
    return kept.select("row.*")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
