import hashlib
import random
import zlib

import pytest

from lithogrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract read literally: whole prefixes as dictionary keys."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    nodes = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        head = [t[3:] for t in sorted(own.get(conv - conv % 100, []))[:h]]
        whole = tuple(head + [t[3:] for t in sorted(own[conv])[h:]])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((conv, d == len(whole)))
    below = {}
    for key in nodes:
        for d in range(len(key) + 1):
            below.setdefault(key[:d], []).append(key)
    found = []
    for key, members in nodes.items():
        children = {k for k in below[key] if len(k) == len(key) + 1}
        leaves = [k for k in below[key] if len(below[k]) == 1]
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below[key])
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        found.append((min(c for c, _ in members), len(key), min(c for c, _ in nodes[key[:-1]]) if key else None, len(members),
                      len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def odd_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, "long " * 50]))
            for c in [*range(0, 40), *range(100, 130), *range(203, 220)] for t in range(rng.randint(1, 7))]
    rows += [(300, None, "user", "first"), (300, 4, None, None), (301, 2, "user", ""), (302, 0, "user", "first"),
             (None, 0, "user", "nobody"), (0, None, "system", "s"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, 3, "user", "other tie")]
    rows += [(400 + i, 0, "user", "same") for i in range(60)]  # all end at one node, some of them rebuilt from one turn
    rows += [(501, t, "user", f"t{t % 3}") for t in range(70)] + [(601, t, "user", f"t{t % 3}") for t in range(64)]  # deep
    return rows


@pytest.mark.parametrize("band,piece", [(8, 1 << 14), (3, 2)])
def test_nodes_match_brute_force(spark, band, piece):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "'y' AS k1", "'z' AS chars")
    assert rows_of(prefix_trie.prefix_trie(frame, band, piece)) == brute(rows)


def test_conversation_over_many_partitions(spark):
    """One conversation holds most rows, so its turns are numbered and hashed by several tasks."""
    rows = [(7, t, "user", f"t{t % 5}") for t in range(40)] + [(c, 0, "user", f"c{c}") for c in range(12)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_negative_ids_and_empty_table(spark):
    rows = [(-7, 0, "user", "a"), (-107, 0, "user", "a"), (-100, 0, "system", "b")]
    found = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert sum(r[3] for r in found if r[1] == 0) == 3
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_add_up():
    """A cut sequence carried on from part to part has the hashes of the whole one."""
    class Edge:
        def __init__(self, conv_id, idx, s1, s2, part):
            self.conv_id, self.idx, self.s1, self.s2, self.part = conv_id, idx, s1, s2, part

    values = [3, 1 << 59, 17, 5, 9, 11]

    def prefix(some):
        return tuple(sum(v * pow(x, i + 1, prefix_trie.PRIME) for i, v in enumerate(some)) % prefix_trie.PRIME for x in prefix_trie.BASES)

    parts = [values[:2], values[2:3], values[3:]]
    edges = [Edge(1, len(p), *prefix(p), n) for n, p in enumerate(parts)]
    assert prefix_trie._carried(edges) == [(1, 1, 2, *prefix(values[:2])), (1, 2, 3, *prefix(values[:3]))]
