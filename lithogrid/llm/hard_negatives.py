"""Hard negatives of anchor vectors by bounds along a spanning tree of the anchors.

Vectors are taken as whole numbers, floor(256 * x), and scores are their inner
products. Anchors are dealt into shards of bounded size, and each shard makes
the minimum spanning tree of its anchors. A block of candidates is scored with
the root; at a child anchor a candidate's score lies within edge length times
candidate norm of the bounds at the parent. Only candidates whose bounds reach
into a wanted window are rescored, and their exact scores bound the anchors below.

The stated query set, the anchors, meets all rows in blocks: each wave of
shards is broadcast, every task passes over its rows once and hands on the best
few of each list that it keeps, and a window over those lists gives the result.

Rows with a null id, a null label, a null vector, or a null or non-finite
component take no part. Missing components of shorter vectors count as zero.
Ties are by the smaller id. Rows that repeat an id are rows of their own, but
never positives of an anchor with that id; an anchor that repeats as a whole
counts once. Scores beyond 64 bits take the nearest 64-bit number. Other
columns are not looked at; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithogrid.llm.common import Shared, table

POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score between which a negative's score lies.
LEAST, MOST = 30, 90
SCALE = 256
#: Anchors and bytes of anchors in a shard, on average; shards in one broadcast.
SHARD, SHARD_BYTES, WAVE = 2048, 8 << 20, 4
#: Candidates that are bounded together.
BLOCK = 4096
_TOP = (1 << 63) - 1


def sound_rows(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select(
        F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("vector"))


def _matrix(vectors: pa.Array, least: int = 0) -> np.ndarray:
    """Whole numbers as doubles, one row a vector; short vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(sizes), max(least, int(sizes.max(initial=0)))))
    found[np.arange(found.shape[1]) < sizes[:, None]] = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False))
    return found


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def spanning_tree(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of visit, parent's place in that order (-1 for the root) and edge length, of the minimum spanning tree.

    Children with the most below them come last, so few bounds wait at a time.
    """
    n = len(anchors)
    norms = (anchors * anchors).sum(1)
    parent, best, out = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    taken, now = [0], 0
    out[0] = False
    for _ in range(n - 1):
        apart = np.maximum(norms + norms[now] - 2 * (anchors @ anchors[now]), 0)
        nearer = out & (apart < best)
        best[nearer], parent[nearer] = apart[nearer], now
        now = int(np.where(out, best, np.inf).argmin()) if np.isfinite(best[out]).any() else int(np.flatnonzero(out)[0])
        if parent[now] < 0:
            parent[now] = 0
        out[now] = False
        taken.append(now)
    below = np.ones(n, np.int64)
    for at in reversed(taken[1:]):
        below[parent[at]] += below[at]
    children: dict[int, list[int]] = {}
    for at in taken[1:]:
        children.setdefault(int(parent[at]), []).append(at)
    order, waiting = [], [0]
    while waiting:
        at = waiting.pop()
        order.append(at)
        waiting += sorted(children.get(at, []), key=lambda c: -below[c])
    order = np.array(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    up = np.where(parent[order] < 0, -1, place[parent[order]])
    length = np.sqrt(((anchors[order] - anchors[order][np.maximum(up, 0)]) ** 2).sum(1))
    return order, up, length


def _plant(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard in order of visit, with the parent and edge length of each."""
    whole = pa.Table.from_batches(list(groups)).combine_chunks()
    order, up, length = spanning_tree(_matrix(whole.column("vector").combine_chunks()))
    whole = whole.take(pa.array(order))
    for name, column in (("at", pa.array(np.arange(len(order)))), ("up", pa.array(up)), ("length", pa.array(length))):
        whole = whole.append_column(name, column)
    yield from whole.to_batches()


@dataclass
class Shard:
    """Plain arrays of one shard: anchors in order of visit and the windows of their positives."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    up: np.ndarray
    length: np.ndarray
    windows: list[list[tuple[int, int]]]

    def state(self) -> dict:
        return dict(self.__dict__)


def _scores(rows: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; ``bound`` is no less than any sum of absolute products."""
    if bound < 1 << 53:
        return (rows @ anchor).astype(np.int64)
    if bound < 1 << 62:
        return rows.astype(np.int64) @ anchor.astype(np.int64)
    other = [int(x) for x in anchor]
    return np.array([max(-_TOP - 1, min(_TOP, sum(int(x) * y for x, y in zip(row, other)))) for row in rows], np.int64)


class Best:
    """The first ``k`` (score, id) of a list so far; higher scores come first, ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a row must reach to come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else -_TOP - 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~scores))[:self.k]  # ~s falls as s rises, without overflow
        self.scores, self.ids = scores[order], ids[order]


def _wanted(shard: Shard, at: int, lists: list[Best], positives: bool) -> list[tuple[int, int]]:
    """Score windows that can still change the lists of one anchor."""
    if positives:
        return [(lists[0].least, _TOP)]
    return [(max(low, kept.least), high) for (low, high), kept in zip(shard.windows[at], lists)]


def bounded_scores(shard: Shard, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray,
                   kept: list[list[Best]], positives: bool) -> int:
    """Bring the lists of all anchors of a shard up to date with a block of rows; returns the number of scores made."""
    width = max(rows.shape[1], shard.vectors.shape[1])
    rows, anchors = _wide(rows, width), _wide(shard.vectors, width)
    norms = np.sqrt((rows * rows).sum(1))
    most = np.abs(rows).sum(1).max(initial=0)
    waiting: dict[int, list] = {}
    children = np.bincount(shard.up[1:], minlength=len(shard.up)) if len(shard.up) > 1 else np.zeros(1, np.int64)
    made = 0
    for at in range(len(shard.ids)):
        anchor, lists = anchors[at], kept[at]
        bound = float(most) * float(np.abs(anchor).max(initial=0))
        up = int(shard.up[at])
        if up < 0:
            low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        else:
            entry = waiting[up]
            # rounded outward: the edge, the norms and the bounds are doubles
            reach = norms * (shard.length[at] * (1 + 1e-9)) + 1e-9 * bound + 1e-3
            low, high = entry[0] - reach, entry[1] + reach
            entry[2] -= 1
            if not entry[2]:
                del waiting[up]
        same = labels == shard.labels[at]
        windows = _wanted(shard, at, lists, positives)
        inside = np.zeros(len(rows), bool)
        for least, top in windows:
            if least <= top:
                inside |= (high >= float(least)) & (low <= float(top))
        inside &= (same & (ids != shard.ids[at])) if positives else ~same
        if up < 0 and children[at]:
            inside |= True  # the root bounds all others
        chosen = np.flatnonzero(inside)
        if len(chosen):
            scores = _scores(rows if len(chosen) == len(rows) else rows[chosen], anchor, bound)
            made += len(chosen)
            low[chosen] = high[chosen] = scores
            fit = (same & (ids != shard.ids[at]))[chosen] if positives else ~same[chosen]
            for (least, top), best in zip(windows, lists):
                take = fit & (scores >= least) & (scores <= top)
                if take.any():
                    best.add(scores[take], ids[chosen[take]])
        if children[at]:
            waiting[at] = [low, high, int(children[at])]
    return made


def _pass(sent, positives: bool):
    """A task's rows against a wave of shards: the best of every list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Shard(**s) for s in sent.value]
        kept = [[[Best(POSITIVES)] if positives else [Best(NEGATIVES) for _ in w] for w in s.windows] for s in shards]
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                some = batch.slice(start, BLOCK)
                rows, (ids, labels) = _matrix(some.column("vector")), (some.column(c).to_numpy() for c in ("vec_id", "label"))
                for shard, lists in zip(shards, kept):
                    bounded_scores(shard, rows, ids, labels, lists, positives)
        for shard, lists in zip(shards, kept):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for at, own in enumerate(lists):
                for slot, best in enumerate(own):
                    for column, values in zip(columns, (np.full(len(best.ids), at), np.full(len(best.ids), slot), best.ids, best.scores)):
                        column.append(values)
            if columns[0]:
                at, slot, ids, scores = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard.number)), pa.array(at), pa.array(slot), pa.array(ids), pa.array(scores)],
                    ["shard", "at", "slot", "id", "score"])

    return run


def _waves(rows: DataFrame, trees: DataFrame, shards: int, positives: bool, shared: Shared) -> DataFrame | None:
    """One job a wave of shards, each written before the next is sent out."""
    sc, found = rows.sparkSession.sparkContext, None
    for first in range(0, shards, WAVE):
        held = {}
        for r in trees.filter(F.col("shard").between(first, first + WAVE - 1)).collect():
            held.setdefault(r.shard, []).append(r)
        sent = []
        for number, own in sorted(held.items()):
            own.sort(key=lambda r: r.at)
            windows = [[(-((-LEAST * p.score) // 100), MOST * p.score // 100) for p in r.positives or []] if not positives else []
                       for r in own]
            sent.append(Shard(
                number, np.array([r.vec_id for r in own]), np.array([r.label for r in own]),
                _matrix(pa.array([r.vector for r in own], pa.list_(pa.float64()))), np.array([r.up for r in own]),
                np.array([r.length for r in own]), windows).state())
        if not sent:
            continue
        # few tasks, each with many rows: every task hands on its own lists
        part = shared.save(rows.coalesce(4 * sc.defaultParallelism).mapInArrow(
            _pass(sc.broadcast(sent), positives), "shard long, at long, slot long, id long, score long"),
            f"{'positives' if positives else 'negatives'}-{first}")
        found = part if found is None else found.unionByName(part)
    return found


def _first(lists: DataFrame, k: int) -> DataFrame:
    """The first k rows of each list over all tasks, with their rank."""
    order = Window.partitionBy("shard", "at", "slot").orderBy(F.col("score").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    shared = Shared(spark)
    rows = sound_rows(vectors, column)
    anchors = shared.save(rows.filter("vec_id % 100 = 0").distinct(), "anchors")
    count, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    shards = -(-count // max(1, min(SHARD, SHARD_BYTES // (8 * max(1, width)))))
    dealt = anchors.repartitionByRange(shards, "label", "vec_id").withColumn("shard", F.spark_partition_id().cast("long"))
    dealt = shared.save(dealt, "shards")
    trees = shared.save(dealt.groupBy("shard").applyInArrow(
        _plant, "vec_id long, label long, vector array<double>, shard long, at long, up long, length double"), "trees")
    empty = F.lit(None).cast("array<struct<rank:int,id:bigint,score:bigint>>")
    lists = _waves(rows, trees.withColumn("positives", empty), shards, True, shared)
    positives = _first(lists, POSITIVES).groupBy("shard", "at").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most POSITIVES elements
    trees = shared.save(trees.join(positives, ["shard", "at"], "left"), "windows")
    lists = _waves(rows, trees, shards, False, shared)
    named = trees.select("shard", "at", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("slot", "p")).select(
        "shard", "at", F.col("slot").cast("long"), "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return _first(lists, NEGATIVES).join(named, ["shard", "at", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label, a.q, b.vec_id AS positive_id, list_inner_product(a.q, b.q)::BIGINT AS positive_score
  FROM v AS a JOIN v AS b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, b.vec_id) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, b.vec_id AS negative_id, list_inner_product(p.q, b.q)::BIGINT AS negative_score
  FROM p JOIN v AS b ON b.label <> p.label)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, negative_id, positive_score, negative_score
FROM n WHERE {LEAST} * positive_score <= 100 * negative_score AND 100 * negative_score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)
QUALIFY rank <= {NEGATIVES}
"""
