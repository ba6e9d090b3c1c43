"""Near-duplicates by SetSketch registers over 5-word shingles.

A text's set holds the 64-bit hashes of its distinct shingles. Texts with the
same set (128-bit digest) are one class. Register i of a class is the smallest
of the exponentially distributed values that hash i gives to its shingles,
kept as its truncated logarithm to ``BASE``: registers of parts of a set merge
by their maximum, and equal registers are likelier the more two sets share.

1. Classes that agree in all registers of a band share a key; two sets at the
   threshold share none of the ``BANDS`` keys with a chance below 1e-6.
2. In a key's run the registers of two classes are compared, and the joint
   likelihood of (more, less, equal) registers and both set sizes says whether
   a similarity at the threshold is possible at odds of ``ODDS``. A run passes
   on a forest of such pairs; a key with over ``LIMIT`` classes ties them all
   to one instead. Components of these links are clusters: no link leaves one.
3. Clusters are verified on whole sets, each of which moves once. A cluster
   that is too large for one task is first compared with one pivot, block by
   block; members without a link to it then meet all blocks. A pair is verified
   where it is possible by its sizes and registers and not yet connected.

Null and wordless texts have the empty set and stay alone. A row without an id
takes the smallest id of its component, null if there is none; its ``kept`` is
false. Rows that repeat an id are rows of their own. Ids are compared as
numbers. Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.llm.common import Shared, join_by_size, table
from lithogrid.llm.components import components

SHINGLE = 5
#: Similarity of linked sets, in hundredths.
PERCENT = 85
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Registers are logarithms to this base of rates of RATE a shingle.
BASE, RATE = 1.2, 20.0
#: Odds against a link at which registers rule a pair out.
ODDS = 1e9
#: Classes at a key that are compared there.
LIMIT = 512
#: Classes of a run whose pairs are all judged at once.
FEW_PAIRS = 48
#: Classes and shingles that one verifying task holds at once.
BLOCK, WEIGHT = 1024, 1 << 22
#: Ids of clustered classes that are broadcast to fetch their texts (8 bytes each).
FEW = 1 << 20
_SLICE = 1 << 15
_MULTIPLY, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(REGISTERS)], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _FINISH
    values ^= values >> np.uint64(32)
    values *= _MULTIPLY
    values ^= values >> np.uint64(29)
    return values


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    found = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        found = found * _MULTIPLY + hashes[i:len(words) - width + 1 + i]
    return np.unique(_mixed(found + np.uint64(width)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers a set; none of the sets is empty."""
    least = np.empty((len(sets), REGISTERS), np.uint64)
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    for i, seed in enumerate(_SEEDS):
        least[:, i] = np.minimum.reduceat(_mixed(joined ^ seed), starts)
    return levels(least)


def levels(least: np.ndarray) -> np.ndarray:
    """Truncated logarithms of the exponential values that belong to the smallest hashes."""
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64.0 * (1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, 255).astype(np.uint8)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of many sets, some of them long: parts are sketched apart and merged by their maximum."""
    found = np.zeros((len(sets), REGISTERS), np.uint8)
    owners: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    for n, own in enumerate(sets):
        for at in range(0, len(own), _SLICE):
            parts.append(own[at:at + _SLICE])
            owners.append(n)
            held += len(parts[-1])
            if held >= _SLICE:
                np.maximum.at(found, owners, registers(parts))
                owners, parts, held = [], [], 0
    if parts:
        np.maximum.at(found, owners, registers(parts))
    return found


def _chance(x: np.ndarray) -> np.ndarray:
    """Chance that a register is greater where a share x of the union is in that set alone."""
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)


def _fit(more: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of the register counts of sets of sizes a and b at a similarity."""
    share = a / (a + b).astype(np.float64)
    greater, lower = _chance(share - (1 - share) * similarity), _chance(1 - share - share * similarity)
    return more * np.log(greater) + less * np.log(lower) + (REGISTERS - more - less) * np.log(np.maximum(1 - greater - lower, 1e-12))


_GRID = np.linspace(0.01, 1, 34)


def estimate(more: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most likely similarity on a grid of hundredths by three."""
    limit = np.minimum(a, b) / np.maximum(a, b)
    fits = [np.where(s <= limit + 0.03, _fit(more, less, a, b, np.minimum(np.full(len(more), s), limit)), -np.inf) for s in _GRID]
    return _GRID[np.argmax(fits, axis=0)]


def possible(more: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with these register counts may reach the threshold."""
    fits = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
    at = np.flatnonzero(fits)
    limit = np.minimum(a[at], b[at]) / np.maximum(a[at], b[at])
    here = _fit(more[at], less[at], a[at], b[at], np.minimum(PERCENT / 100, limit))
    above = _fit(more[at], less[at], a[at], b[at], np.minimum(PERCENT / 100 + 0.005, limit))
    open_ = above < here  # the others are likelier above the threshold
    at, here, limit = at[open_], here[open_], limit[open_]
    if len(at):
        more, less, a, b, best = more[at], less[at], a[at], b[at], here
        for s in _GRID[_GRID < PERCENT / 100 + 0.03]:
            best = np.maximum(best, _fit(more, less, a, b, np.minimum(s, limit)))
        fits[at] = best - here <= math.log(ODDS)
    return fits


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold, on the whole sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        start = 0
        while start < len(batch):  # some texts at a time: their sets are eight bytes a word
            stop, size = start, 0
            while stop < len(batch) and size < 4 << 20:
                size += texts[stop].as_buffer().size if texts[stop].is_valid else 0
                stop += 1
            sets = [shingle_set(t.as_py()) for t in texts[start:stop]]
            found = sketches(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[start:stop],
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([bytes(r) for r in found], pa.binary()),
            ], ["doc_id", "digest", "n", "sketch"])
            start = stop


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([np.frombuffer(s, np.uint8) for s in batch.column("sketch").to_pylist()], np.uint64).reshape(-1, BANDS, ROWS)
        keys = np.zeros(rows.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            keys = _mixed(keys * _MULTIPLY + rows[:, :, i])
        for band in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, band].view(np.int64)), batch.column("digest")], ["key", "digest"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns of its rows) for each run of equal keys in sorted batches."""
    key, held = None, None
    for batch in batches:
        for row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), *(batch.column(c).to_pylist() for c in columns)):
            if row[0] != key:
                if held is not None:
                    yield key, held
                key, held = row[0], [[] for _ in columns]
            for own, value in zip(held, row[1:]):
                own.append(value)
    if held is not None:
        yield key, held


class _Forest:
    """Union-find over the places of a run; keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.root, self.links = np.arange(size), []

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root[a], self.root[b]
        if ra != rb:
            self.root[self.root == max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def _stars(names: list[bytes], links: list[tuple[int, int]]) -> list[tuple[bytes, bytes]]:
    """The trees of some links as stars: each end with the smallest name of its tree, so that few rounds join them up."""
    root = {x: x for link in links for x in link}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if names[a] < names[b]:
            a, b = b, a
        root[a] = b
    return [(names[x], names[find(x)]) for x in root if find(x) != x]


def _linked(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])


def _matched(rows: np.ndarray, at: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The others whose registers and sizes leave a link to one row possible."""
    same = rows[others].astype(np.int16) - rows[at]
    own = np.full(len(others), sizes[at])
    return others[possible((same < 0).sum(1), (same > 0).sum(1), own, sizes[others])]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the possible pairs of every key's classes; the pairs of small runs are judged many runs at a time."""
    digests: list[list[bytes]] = []
    rows: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = first = 0

    def judged() -> list[tuple[bytes, bytes]]:
        drawn, n, a, b = np.concatenate(rows), np.concatenate(sizes), np.concatenate(left), np.concatenate(right)
        names = [d for run in digests for d in run]
        apart = drawn[b].astype(np.int16) - drawn[a]
        kept = np.flatnonzero(possible((apart < 0).sum(1), (apart > 0).sum(1), n[a], n[b]))
        return _stars(names, list(zip(a[kept].tolist(), b[kept].tolist())))

    for _, (own, n, drawn) in _runs(batches, ["key"], ["digest", "n", "sketch"]):
        matrix, n = np.array([np.frombuffer(s, np.uint8) for s in drawn]), np.array(n)
        if len(own) <= FEW_PAIRS:
            x, y = np.triu_indices(len(own), 1)
            for to, what in ((digests, own), (rows, matrix), (sizes, n), (left, x + first), (right, y + first)):
                to.append(what)
            held, first = held + len(x), first + len(own)
            if held >= 1 << 14:
                if links := judged():
                    yield _linked(links)
                digests, rows, sizes, left, right, held, first = [], [], [], [], [], 0, 0
            continue
        forest = _Forest(len(own))
        for i in range(len(own) - 1):
            others = np.flatnonzero(forest.root[i + 1:] != forest.root[i]) + i + 1
            for j in _matched(matrix, i, others, n) if len(others) else ():
                forest.join(i, int(j))
        if forest.links:
            yield _linked(_stars(own, forest.links))
    if held and (links := judged()):
        yield _linked(links)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 64):
            some = batch.slice(start, 64)
            sets = [shingle_set(t.as_py()) for t in some.column("text")]
            yield pa.RecordBatch.from_arrays([
                some.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "digest", "shingles"])


ROLE_PIVOT, ROLE_MEMBER, ROLE_REST = 0, 1, 2


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the classes of each run, on their whole sets, enough for their closure.

    A run has the members of a cluster or of one of its blocks. With a pivot
    they are compared with it alone; with rest rows, which have no link to the
    cluster's pivot, these are compared with each other and with all members.
    Members marked ``tied`` are linked to the pivot already.
    """
    for _, (digests, drawn, packed, role, tied) in _runs(
            batches, ["root", "i", "j"], ["digest", "sketch", "shingles", "role", "tied"]):
        sets = [np.frombuffer(s, np.uint64) for s in packed]
        sizes, rows, role = np.array([len(s) for s in sets]), np.array([np.frombuffer(s, np.uint8) for s in drawn]), np.array(role)
        forest = _Forest(len(sets))
        held = np.flatnonzero(np.array(tied))
        if len(held):
            forest.root[held] = held[0]
        by_digest: dict[bytes, int] = {}
        for place, d in enumerate(digests):  # a rest row is a member of its own block too
            if d in by_digest:
                forest.root[forest.root == forest.root[place]] = forest.root[by_digest[d]]
            by_digest.setdefault(d, place)
        special = np.flatnonzero(role == (ROLE_PIVOT if (role == ROLE_PIVOT).any() else ROLE_REST))
        for i in special if len(special) else range(len(sets)):
            others = np.flatnonzero(forest.root != forest.root[i])
            if not len(special):
                others = others[others > i]
            for j in _matched(rows, int(i), others, sizes) if len(others) else ():
                if forest.root[i] != forest.root[j] and similar(sets[i], sets[j]):
                    forest.join(int(i), int(j))
        if forest.links:
            yield _linked(_stars(digests, forest.links))


PAIRS = "a binary, b binary"


def _clusters(classes: DataFrame, shared: Shared, limit: int) -> DataFrame:
    """(node, root) of the classes that may have links."""
    rows = classes.select("digest", "sketch").mapInArrow(_bands, "key long, digest binary")
    keys = shared.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    met = shared.save(join_by_size(rows, keys, "key", "size", total, F.xxhash64("digest")).filter("size IS NOT NULL"), "met")
    cold = met.filter(F.col("size") <= limit).select("key", "digest").join(classes.select("digest", "n", "sketch"), "digest")
    near = cold.repartition("key").sortWithinPartitions("key").select("key", "digest", "n", "sketch").mapInArrow(_compare, PAIRS)
    hot = met.filter(F.col("size") > limit)
    centres = hot.groupBy("key").agg(F.min("digest").alias("centre"), F.count(F.lit(1)).alias("size"))
    tied = join_by_size(hot.drop("size"), centres, "key", "size", total, F.xxhash64("digest")).select(
        F.col("digest").alias("a"), F.col("centre").alias("b"))
    return components(near.unionByName(tied), Shared(shared.spark))


def _fetched(docs: DataFrame, wanted: DataFrame, shared: Shared, repeated: bool) -> DataFrame:
    """(digest, root, count, weight, sketch, shingles) of the wanted classes, from the text of their smallest id."""
    ids = wanted.select(F.col("id").alias("_id")).distinct()
    few = wanted.count() <= FEW
    texts = docs.select("doc_id", "text").join(
        F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, digest binary, shingles binary")
    found = sets.withColumnRenamed("digest", "_digest").join(
        wanted, (F.col("_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id"))).drop("_digest", "doc_id", "id")
    return found.dropDuplicates(["digest"]) if repeated else found


def verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, shared: Shared, repeated: bool) -> DataFrame:
    """Links (a, b) between classes whose transitive closure is that of all links."""
    placed = classes.join(clusters, classes.digest == clusters.node).select("digest", "id", "n", "sketch", "root")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / WEIGHT))
    sizes = shared.save(sizes.select("root", "members", blocks.alias("blocks")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    wanted = shared.save(join_by_size(placed, sizes, "root", "members", total, F.xxhash64("digest")).drop("members"), "wanted")
    rows = _fetched(docs, wanted, shared, repeated)
    if sizes.filter("blocks > 1").isEmpty():
        return shared.save(_verified(rows, F.lit(0), F.lit(0), F.lit(ROLE_MEMBER)), "links")
    rows = shared.save(rows, "sets")
    links = shared.save(_verified(rows.filter("blocks = 1"), F.lit(0), F.lit(0), F.lit(ROLE_MEMBER)), "links")
    # large clusters: everything against the pivot, then what has no link to it against everything
    large = rows.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pivots = large.filter("digest = root").withColumn("j", every).withColumn("role", F.lit(ROLE_PIVOT))
    members = large.filter("digest <> root").withColumn("j", F.col("block")).withColumn("role", F.lit(ROLE_MEMBER))
    star = shared.save(_verified(pivots.unionByName(members), F.lit(0), F.col("j"), F.col("role")), "star")
    found = star.select(F.explode(F.array("a", "b")).alias("digest")).distinct().withColumn("tied", F.lit(True))
    marked = large.join(found, "digest", "left").withColumn(
        "tied", F.coalesce("tied", F.lit(False)) | (F.col("digest") == F.col("root")))
    rest = marked.filter("NOT tied")
    parts = rest.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("shingles") / 8).alias("w")).select(
        "root", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("w") / WEIGHT)).alias("parts"))
    parts = shared.save(parts, "parts")
    if parts.isEmpty():
        return links.unionByName(star)
    # one row a large cluster; there are at most as many as blocks of BLOCK classes or WEIGHT shingles
    marked = marked.join(parts, "root")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = marked.filter("NOT tied").withColumn("i", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("parts"))).withColumn(
        "j", every).withColumn("role", F.lit(ROLE_REST))
    right = marked.withColumn("i", part).withColumn("j", F.col("block")).withColumn("role", F.lit(ROLE_MEMBER))
    crossed = shared.save(_verified(left.unionByName(right), F.col("i"), F.col("j"), F.col("role"), F.col("tied")), "crossed")
    return links.unionByName(star).unionByName(crossed)


def _verified(rows: DataFrame, i, j, role, tied=None) -> DataFrame:
    keys = ["root", "i", "j"]
    return rows.select("root", i.cast("long").alias("i"), j.cast("long").alias("j"), "digest", "sketch", "shingles",
                       role.alias("role"), (F.lit(False) if tied is None else tied).alias("tied")).repartition(
        *keys).sortWithinPartitions(*keys, "role", "digest").mapInArrow(_verify, PAIRS)


def setsketch_dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    shared = Shared(docs.sparkSession)
    prints = shared.save(docs.select("doc_id", "text").mapInArrow(
        _prints, "doc_id long, digest binary, n long, sketch binary"), "prints")
    full = prints.filter("n > 0")
    repeated = not full.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty()
    classes = shared.save(full.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("members"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
    clusters = _clusters(classes, shared, limit)
    links = verified_links(docs, classes, clusters, shared, repeated)
    roots = components(links, Shared(shared.spark))
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    placed = shared.save(classes.join(roots, classes.digest == roots.node, "left").select(
        "digest", "id", "members", F.coalesce("root", "digest").alias("root")), "placed")
    least = shared.save(placed.groupBy("root").agg(
        F.min("id").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    named = shared.save(join_by_size(placed, least, "root", "size", total, F.xxhash64("digest")).select(
        "digest", "members", "component_id"), "named")
    found = join_by_size(prints.drop("sketch"), named, "digest", "members", total, F.col("doc_id"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op11_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
