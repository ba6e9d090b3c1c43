import random

import numpy as np
import pytest
import xxhash

from lithogrid.llm import simhash
from lithogrid.llm.common import Shared


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids_and_prints):
    root = {i: i for i, _ in ids_and_prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in ids_and_prints:
        for j, b in ids_and_prints:
            if i < j and (a ^ b).bit_count() <= 2:
                ri, rj = find(i), find(j)
                root[max(ri, rj)] = min(ri, rj)
    return {i: find(i) for i, _ in ids_and_prints}


@pytest.mark.parametrize("text", [None, "", " ", "One", "one two", "A b C d É é", "a b c " * 300, "x y z\x0bw v", "q " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_linked_prints_share_an_anchor():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        signed = np.array([a, b], np.uint64).view(np.int64)
        key, fp = simhash.anchors(signed)
        assert set(key[fp == signed[0]]) & set(key[fp == signed[1]])


def clustered(count, rng):
    prints = set()
    for _ in range(count):
        a = rng.getrandbits(64)
        for _ in range(20):
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                b ^= 1 << bit
            prints.add(b)
    return [(i, p) for i, p in enumerate(sorted(prints))]


@pytest.mark.parametrize("limit", [1024, 6])
def test_components_match_brute_force(spark, limit):
    """A low limit sends every anchor of a cluster through the second pass."""
    rows = clustered(25, random.Random(2))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    named, _ = simhash.near_classes(spark.createDataFrame(signed, "doc_id long, fp long"), Shared(spark), limit)
    to = {r.fp: r.component_id for r in named.collect()}
    assert {i: to[p] for i, p in signed} == brute(rows)


def test_documents(docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base.replace("w200 ", "other ")), (9, base.upper()), (5, "short text"), (6, None), (2, "  "),
            (None, base), (1, "quite another text of some words"), (8, "short text"), (8, "short text")]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.simhash_dedup(docs_of(rows)).collect()}
    want = brute([(n, slow_fingerprint(t)) for n, (_, t) in enumerate(rows)])
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[want[n]] = min(i, least.get(want[n], i))
    for n, (i, t) in enumerate(rows):
        assert got[i, simhash.fingerprint(t)] == least[want[n]]
    kept = simhash.keep_one(docs_of(rows).withColumn("fp", __import__("pyspark").sql.functions.lit("own")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert kept.columns[-1] == "fp"
    assert simhash.simhash_dedup(docs_of([])).count() == 0
