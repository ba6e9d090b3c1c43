"""Prefix trie of rebuilt conversations by depth-band rollup.

A conversation c starts with the first h turns of conversation c - c % 100 and
goes on with its own turns after its first h, h = crc32(decimal c) % 6. A node
is a distinct sequence of first turns. Its key is a pair of polynomial hashes
modulo 2^61 - 1 over the SHA-256 values of the turns: such sums can be cut
anywhere, so a conversation that holds a third of all turns is numbered and
hashed by many tasks, and a rebuilt sequence takes its key from two prefixes.

Rollup: every node goes only to its ancestors within its band of ``BAND``
depths, itself included; then bands are completed from the deepest up, where
the totals of a band's roots go to the ancestors of their parents. A node makes
at most ``BAND`` rows, a round is one band and reads that band's folder. Conversation ids that end at a node
are sorted over many tasks into pieces of text, which one task streams into the hash.

Null roles and texts are empty; null turns come first; rows of equal turn are
ordered by the SHA-256 of role and text, so repeated rows follow each other.
Rows without a conv_id take no part. Other columns are not looked at. An empty
table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithogrid.llm.common import Shared, join_by_size, table

#: Turns taken over from the conversation that opens each hundred.
SHARED_TURNS = 6
#: Depths in one band of the rollup.
BAND = 32
#: Conversation ids in one piece of text.
PIECE = 1 << 14

PRIME = (1 << 61) - 1
BASES = (0x123456789ABCDEF, 0x0FEDCBA987654321)


def turn_digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix hashes of the turns of one sorted partition, then the totals of its first and last conversation."""
    part = TaskContext.get().partitionId()
    names = ["conv_id", "idx", "s1", "s2", "chars", "part", "edge"]

    def out(rows: list[tuple], chars: list, edge: bool) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(chars, pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array([edge] * len(rows))], names)

    now, first = None, None
    for batch in batches:
        rows, chars = [], batch.column("chars").to_pylist()
        for conv, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "a", "b"))):
            if now is None or conv != now[0]:
                if now is not None and first is None:
                    first = now
                now, p, q = (conv, 0, 0, 0), BASES[0], BASES[1]
            now = (conv, now[1] + 1, (now[2] + a * p) % PRIME, (now[3] + b * q) % PRIME)
            p, q = p * BASES[0] % PRIME, q * BASES[1] % PRIME
            rows.append(now)
        if rows:
            yield out(rows, chars, False)
    if now is not None:
        ends = [now] if first is None else [first, now]
        yield out(ends, [0] * len(ends), True)


def _carried(edges: list) -> list[tuple[int, int, int, int, int]]:
    """(conv_id, part, turns before, hashes before) where a conversation goes on from an earlier partition."""
    found, carry, parts = [], (None, 0, 0, 0), {}
    for e in edges:
        parts.setdefault(e.part, []).append(e)
    for part in sorted(parts):
        ends = sorted(parts[part], key=lambda e: e.conv_id)
        head, tail = ends[0], ends[-1]
        if carry[0] == head.conv_id:
            found.append((head.conv_id, part, *carry[1:]))
        else:
            carry = (None, 0, 0, 0)
        if head is tail:
            n = carry[1]
            carry = (tail.conv_id, n + tail.idx, *(
                (before + s * pow(x, n, PRIME)) % PRIME for before, s, x in zip(carry[2:], (tail.s1, tail.s2), BASES)))
        else:
            carry = (tail.conv_id, tail.idx, tail.s1, tail.s2)
    return found


KEY = "k1 long, k2 long"


@F.pandas_udf(T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]))
def _moved(s1: pd.Series, s2: pd.Series, by: pd.Series, less1: pd.Series, less2: pd.Series,
           more1: pd.Series, more2: pd.Series) -> pd.DataFrame:
    """more + base ** by * (s - less), for both hashes."""
    columns, powers = [], [{}, {}]
    for k, (s, less, more) in enumerate(((s1, less1, more1), (s2, less2, more2))):
        made, known = [], powers[k]
        for value, n, low, high in zip(s.tolist(), by.tolist(), less.tolist(), more.tolist()):
            if n not in known:
                known[n] = pow(BASES[k], n, PRIME)
            made.append((high + known[n] * (value - low)) % PRIME)
        columns.append(pd.Series(made, dtype="int64"))
    return pd.DataFrame({"k1": columns[0], "k2": columns[1]})


def _turns(conversations: DataFrame, shared: Shared) -> DataFrame:
    """(conv_id, idx, s1, s2, chars): every turn with its place from 1 and the hashes of the turns up to it."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = rows.select("conv_id", "turn", turn_digest().alias("digest"), F.length("text").cast("long").alias("chars")).select(
        "*", part(1).alias("a"), part(16).alias("b"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    numbered = shared.save(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "chars").mapInArrow(
            _number, "conv_id long, idx long, s1 long, s2 long, chars long, part long, edge boolean"), "numbered")
    carried = _carried(numbered.filter("edge").collect())  # two rows a partition
    turns = numbered.filter("NOT edge")
    if not carried:
        return turns.drop("part", "edge")
    before = shared.spark.createDataFrame(carried, "conv_id long, part long, n long, b1 long, b2 long")
    n, zero = F.coalesce("n", F.lit(0)), F.lit(0)
    moved = turns.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("idx") + n).alias("idx"), "chars", _moved(
            "s1", "s2", n, zero, zero, F.coalesce("b1", zero), F.coalesce("b2", zero)).alias("s"))
    return shared.save(moved.select("conv_id", "idx", F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2"), "chars"), "turns")


def rebuilt(conversations: DataFrame, shared: Shared) -> DataFrame:
    """(conv_id, pos, k1, k2, chars, last) for each prefix of each rebuilt conversation, the empty one included."""
    turns = _turns(conversations, shared)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED_TURNS)).cast("long")
    turns = turns.withColumn("h", h)
    heads = turns.filter(f"conv_id % 100 = 0 AND idx < {SHARED_TURNS}").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "s1", "s2", "chars"))).alias("head"))
    at_h = F.col("idx") == F.col("h")
    convs = turns.groupBy("conv_id", "h").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.max(F.when(at_h, F.col(s))), F.lit(0)).alias(f"less{s[1]}") for s in ("s1", "s2")])
    placed = convs.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))).withColumn(
        "m", F.size("head").cast("long")).withColumn("more", F.try_element_at("head", F.lit(-1)))
    placed = shared.save(placed.select(
        "conv_id", "n", "h", "m", "head", "less1", "less2", F.coalesce("more.s1", F.lit(0)).alias("more1"),
        F.coalesce("more.s2", F.lit(0)).alias("more2"), F.expr("m + greatest(n - h, 0)").alias("turns")), "placed")
    first = placed.select("conv_id", "turns", F.explode(F.concat(
        F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("idx", "s1", "s2", "chars")])), "head")).alias("t")).select(
        "conv_id", F.col("t.idx").alias("pos"), F.col("t.s1").alias("k1"), F.col("t.s2").alias("k2"), F.col("t.chars").alias("chars"),
        (F.col("t.idx") == F.col("turns")).alias("last"))
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = join_by_size(turns.filter("idx > h"), placed.drop("h", "head"), "conv_id", "n", total, F.col("idx"))
    own = own.select("conv_id", F.expr("m + idx - h").alias("pos"), "chars", "turns", _moved(
        "s1", "s2", F.expr("m - h"), "less1", "less2", "more1", "more2").alias("k"))
    own = own.select("conv_id", "pos", "k.k1", "k.k2", "chars", (F.col("pos") == F.col("turns")).alias("last"))
    return shared.save(first.unionByName(own), "rebuilt")


def _nodes(rows: DataFrame, shared: Shared, band: int) -> DataFrame:
    """One row per node: key, depth, smallest member, members, parent's key, and ``path``, its ancestors within the band."""
    at = F.floor(F.col("pos") / band)
    both = F.when(F.pmod(F.col("pos") + 1, F.lit(band)) == 0, F.array(at, at + 1)).otherwise(F.array(at))
    groups = rows.select("conv_id", "pos", "k1", "k2", "chars", F.explode(both).alias("band")).groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "chars"))).alias("run"))  # at most band + 1 elements
    member = groups.select("conv_id", "band", "run", F.posexplode("run").alias("i", "e")).filter(
        F.floor(F.col("e.pos") / band) == F.col("band"))
    member = member.select(
        "conv_id", F.col("e.k1").alias("k1"), F.col("e.k2").alias("k2"), F.col("e.pos").alias("depth"), F.col("e.chars").alias("chars"),
        F.expr("get(run, i - 1)").alias("parent"),
        F.expr(f"transform(filter(slice(run, 1, i + 1), x -> x.pos >= band * {band}), x -> struct(x.k1, x.k2))").alias("path"))
    return shared.save(member.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"),
        F.max("chars").alias("chars"), F.max("parent.k1").alias("p1"), F.max("parent.k2").alias("p2"), F.any_value("path").alias("path")), "nodes")


def _rollup(nodes: DataFrame, shared: Shared, band: int, deepest: int) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) of every node's subtree, band by band from the deepest."""
    totals, above = [], None
    own = nodes.select("k1", "k2", "p1", "p2", "depth", "level", "path", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    for level in range(deepest // band, -1, -1):
        here = own.filter(F.col("level") == level)
        values = here.select("path", "leaves", "saved")
        if above is not None:
            roots = own.filter((F.col("level") == level + 1) & (F.col("depth") == (level + 1) * band)).drop("leaves", "saved").join(above, ["k1", "k2"])
            passed = roots.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            values = values.unionByName(here.select("k1", "k2", "path").join(passed, ["k1", "k2"]).select("path", "leaves", "saved"))
        above = shared.save(values.select(F.explode("path").alias("at"), "leaves", "saved").groupBy(
            F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), f"totals-{level}")
        totals.append(above)
    found = totals[0]
    for more in totals[1:]:
        found = found.unionByName(more)
    return found.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})


def _pieces(size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Comma-joined ids of one node, cut after ``size`` ids; rows come sorted by node and id."""
        key, ids = None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            k1, k2, first, text = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())],
                ["k1", "k2", "first", "ids"])

        for batch in batches:
            rows = []
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
                if key != (k1, k2) or len(ids) >= size:
                    if ids:
                        rows.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (k1, k2), []
                ids.append(conv)
            if rows:
                yield out(rows)
        if ids:
            yield out([(*key, ids[0], ",".join(map(str, ids)))])

    return pieces


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node; rows come sorted by node and first id."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, digest = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digest, pa.string())], ["k1", "k2", "ends_sha256"])

    key, state = None, None
    for batch in batches:
        rows = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if key == (k1, k2):
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield out(rows)
    if key is not None:
        yield out([(*key, state.hexdigest())])


def _ends(rows: DataFrame, shared: Shared, size: int) -> DataFrame:
    order = ["k1", "k2", "conv_id"]
    pieces = rows.filter("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces(size), f"{KEY}, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hash, f"{KEY}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, band: int = BAND, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    shared = Shared(conversations.sparkSession)
    rows = rebuilt(conversations, shared)
    nodes = _nodes(rows, shared, band)
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = shared.save(nodes.join(children, ["k1", "k2"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))).withColumn("level", F.floor(F.col("depth") / band)), "family", "level")
    deepest, total = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count(F.lit(1))).first()
    totals = _rollup(nodes, shared, band, deepest)
    ends = _ends(rows, shared, piece)
    parents = nodes.filter("n_children > 0").select(
        F.struct(F.col("k1"), F.col("k2")).alias("up"), "n_children", F.col("conv_id").alias("parent_conv_id"))
    named = join_by_size(nodes.select("k1", "k2", "conv_id", "depth", "n_convs", F.col("n_children").alias("n_below"), F.when(
        F.col("depth") > 0, F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))).alias("up")),
        parents, "up", "n_children", total, F.col("k1"))
    return named.drop("n_children").join(totals, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_below").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS idx
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h
  FROM size),
b AS (SELECT c.*, least(c.h, coalesce(size.n, 0)) AS m FROM c LEFT JOIN size ON size.conv_id = c.base),
r AS (
  SELECT b.conv_id, t.idx AS pos, role, text FROM b JOIN t ON t.conv_id = b.base AND t.idx <= b.m
  UNION ALL
  SELECT b.conv_id, b.m + t.idx - b.h, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.idx > b.h),
p AS (
  SELECT conv_id, pos, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
           OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
           OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent,
         pos = max(pos) OVER (PARTITION BY conv_id) AS last
  FROM (SELECT * FROM r UNION ALL SELECT conv_id, 0, NULL, '' FROM c) AS steps),
q AS (SELECT conv_id, pos, chars, last, coalesce(prefix, '') AS prefix, CASE WHEN pos > 0 THEN coalesce(parent, '') END AS parent FROM p),
n AS (
  SELECT pos AS depth, prefix, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM q GROUP BY pos, prefix),
k AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
s AS (
  SELECT q.pos AS depth, q.prefix, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens
  FROM f JOIN q ON q.conv_id = f.conv_id AND q.pos <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, prefix) LEFT JOIN n AS up ON up.depth = f.depth - 1 AND up.prefix = f.parent
"""
