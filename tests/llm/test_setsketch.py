import random
import re

import numpy as np
import pytest

from lithogrid.llm import setsketch as ss


def slow_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set size, smallest id of its component), by all pairs."""
    sets = [(i, slow_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(((i, len(s), least.get(find(n)), i is not None and i == least.get(find(n))) for n, (i, s) in enumerate(sets)), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def near(base, changes, rng):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(rng):
    texts = []
    for size in (40, 90, 200, 600):
        for _ in range(6):
            base = " ".join(f"w{rng.randrange(3000)}" for _ in range(size))
            texts += [base, base.upper(), *(near(base, max(1, size * k // 300), rng) for k in range(1, 9))]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(20)) for _ in range(30)]  # share most, no link
    return [(10 + i, t) for i, t in enumerate(texts)]


ODD = [(1, None), (2, ""), (3, " \t\x0b "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, "alone and without an id"),
       (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d"), (9, "q " * 40_000), (2000, "q q q q q"), (2001, "É é é é é"), (2002, "é é é é é")]


@pytest.mark.parametrize("limit,block,few", [(512, 1024, 1 << 20), (3, 4, 0)])
def test_components_match_brute_force(spark, docs_of, monkeypatch, limit, block, few):
    """Low bounds tie hot keys, cut clusters into blocks and fetch texts by a shuffle."""
    monkeypatch.setattr(ss, "BLOCK", block)
    monkeypatch.setattr(ss, "FEW", few)
    rows = corpus(random.Random(1)) + ODD
    frame = docs_of(rows).selectExpr("*", "'x' AS digest", "'y' AS root", "'z' AS n").repartition(4)
    assert rows_of(ss.setsketch_dedup(frame, limit)) == brute(rows)
    assert ss.setsketch_dedup(docs_of([])).count() == 0


def test_chain_without_a_common_pivot(spark, docs_of, monkeypatch):
    """Each text links to the next only: most members have no link to the pivot of their cluster."""
    monkeypatch.setattr(ss, "BLOCK", 5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = words[4:] + [f"n{i}-{k}" for k in range(4)]
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) == 1
    assert rows_of(ss.setsketch_dedup(docs_of(rows), 2)) == want


def test_registers_merge_and_are_placed_as_the_formula_says():
    rng = np.random.default_rng(2)
    whole = np.unique(rng.integers(0, 1 << 63, 70_000).astype(np.uint64))
    merged = np.maximum(ss.registers([whole[:100]]), ss.registers([whole[100:]]))
    assert (merged == ss.registers([whole])).all() and (ss.sketches([whole])[0] == merged[0]).all()
    few = whole[:7]
    for i in (0, 50, ss.REGISTERS - 1):
        lowest = min(int(ss._mixed(np.array([h], np.uint64) ^ ss._SEEDS[i])[0]) for h in few)
        value = -np.log(1 - (lowest + 0.5) / 2 ** 64) / ss.RATE
        assert ss.registers([few])[0, i] == int(np.clip(np.floor(1 - np.log(value) / np.log(ss.BASE)), 0, 255))


def test_likelihood_estimates_and_keeps_linked_pairs():
    rng = np.random.default_rng(3)
    for similarity, size in ((0.86, 30), (0.86, 2000), (0.95, 300), (0.5, 300), (0.1, 300)):
        both = round(2 * size * similarity / (1 + similarity))
        found, possible = [], []
        for _ in range(60):
            values = rng.integers(0, 1 << 63, 2 * size - both).astype(np.uint64)
            a, b = ss.registers([values[:size], values[size - both:]]).astype(int)
            counts = [np.array([x]) for x in ((a > b).sum(), (a < b).sum(), size, size)]
            found.append(ss.estimate(*counts)[0])
            possible.append(bool(ss.possible(*counts)[0]))
        assert abs(np.mean(found) - similarity) < 0.05
        assert all(possible) if similarity >= 0.85 else np.mean(possible) < (0.1 if similarity > 0.3 else 0.001)


def test_bands_miss_less_than_one_in_a_million():
    equal = 1 - 2 * float(ss._chance(np.array([0.5 - 0.5 * 0.85]))[0])
    assert (1 - equal ** ss.ROWS) ** ss.BANDS < 1e-6
