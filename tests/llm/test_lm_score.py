import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lithogrid.llm import lm_score as X


def brute(rows, good):
    """The models from dictionaries of slots."""
    def slots(text):
        words = "".join(c if c.isalnum() else " " if ord(c) < 128 else c for c in (text or "").lower()).split()
        h = [zlib.crc32(w.encode()) for w in words]
        return [x % (1 << X.WORD_BITS) for x in h], [
            ((a * 0x9E3779B1 ^ b * 0x85EBCA6B) >> 7) % (1 << X.PAIR_BITS) for a, b in zip(h, h[1:])]

    counts = {True: ({}, {}), False: ({}, {})}
    for i, t in rows:
        for target in (True, False):
            if not target or i in good:
                for table, some in zip(counts[target], slots(t)):
                    for s in some:
                        table[s] = table.get(s, 0) + 1
    totals = {k: sum(c[0].values()) for k, c in counts.items()}
    scales = {True: 1.0, False: totals[True] / totals[False] if totals[True] and totals[False] else 1.0}
    out = []
    for i, t in rows:
        words, pairs = slots(t)
        loss = {}
        for target in (True, False):
            own = not target or i in good
            one, two = counts[target]
            c1 = {s: (one.get(s, 0) - own * words.count(s)) * scales[target] for s in words}
            c2 = {s: (two.get(s, 0) - own * pairs.count(s)) * scales[target] for s in pairs}
            n = (totals[target] - own * len(words)) * scales[target]
            p1 = [(c1[s] + X.ALPHA) / (n + X.ALPHA * (1 << X.WORD_BITS)) for s in words]
            total = math.log(p1[0]) if words else 0
            for k, s in enumerate(pairs):
                total += math.log((c2[s] + X.MIX * p1[k + 1]) / (max(c1[words[k]], c2[s]) + X.MIX))
            loss[target] = -total / len(words) if words else 0.0
        out.append((i, i in good, len(words), round(loss[True], 6), round(loss[False], 6)))
    return sorted(map(repr, out))


def test_matches_brute_force(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "of", "Ab", "naïve", "x1", "end."], k=rng.randint(0, 40)))) for i in range(80)]
    rows += [(100, None), (101, " .. "), (None, "the of"), (7, "a repeated id"), (102, "long " * 20_000)]
    good = {i for i in range(0, 80, 3)} | {102}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(3, 1, 1), (3, 0, 0), (1, 0, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.target, r.n_words, round(r.target_loss, 6), round(r.background_loss, 6))
           for r in X.lm_score(docs_of(rows), labels).collect()]
    assert sorted(map(repr, got)) == brute(rows, good)
    none = X.lm_score(docs_of(rows), labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.target for r in none)
    assert X.lm_score(docs_of([]), labels).count() == 0


def test_target_like_texts_score_lower(spark, docs_of):
    rng = random.Random(2)
    kinds = {True: "alpha beta gamma delta".split(), False: "one two three four".split()}
    rows = [(i, " ".join(rng.choices(kinds[i % 2 == 0] + ["and", "or"], k=50))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in X.lm_score(docs_of(rows), labels).collect()}
    assert max(scores[i] for i in range(100, 200, 2)) < min(scores[i] for i in range(101, 200, 2))


def exact(rows, good):
    """Both losses from dictionaries of the words and pairs themselves."""
    texts = [(i, (t or "").split()) for i, t in rows]
    counts = {kind: Counter(g for i, w in texts if not kind or i in good for g in [*w, *zip(w, w[1:])]) for kind in (True, False)}
    totals = {kind: sum(len(w) for i, w in texts if not kind or i in good) for kind in (True, False)}
    size = max(len({x for _, w in texts for x in w}), 1 << X.WORD_BITS)
    out = {}
    for i, words in texts:
        mine, losses = Counter([*words, *zip(words, words[1:])]), []
        for kind in (True, False):
            own, scale = not kind or i in good, 1.0 if kind else totals[True] / totals[False]
            c = {g: (counts[kind][g] - own * n) * scale for g, n in mine.items()}
            n = (totals[kind] - own * len(words)) * scale
            p1 = {w: (c[w] + X.ALPHA) / (n + X.ALPHA * size) for w in words}
            logs = [math.log(p1[words[0]])] + [
                math.log((c[v, w] + X.MIX * p1[w]) / (max(c[v], c[v, w]) + X.MIX)) for v, w in zip(words, words[1:])]
            losses.append(-sum(logs) / len(words))
        out[i] = losses
    return out


def test_more_words_than_a_table_would_have_slots(spark, docs_of, monkeypatch):
    """300,000 words and 600,000 pairs over several blocks: no two share counts."""
    monkeypatch.setattr(X, "BLOCK_BYTES", 200_000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{i * 1500 + k if k % 2 else rng.randrange(300_000)}" for k in range(3000))) for i in range(200)]
    good = set(range(0, 200, 4))
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    want = exact(rows, good)
    for r in X.lm_score(docs_of(rows), labels).collect():
        assert abs(r.target_loss - want[r.doc_id][0]) < 1e-6 and abs(r.background_loss - want[r.doc_id][1]) < 1e-6


def test_cells_and_answers_are_small():
    """Keys travel once, and a block gets a bit for an n-gram that no other block has."""
    rng = np.random.default_rng(5)
    shared, alone = (rng.integers(0, 1 << 64, n, np.uint64) for n in (2000, (8, 20_000)))
    own = [X.counted([np.concatenate([shared, some]), shared[:1000]], [k == 0, False]) for k, some in enumerate(alone)]
    packed = [X._pack(c) for c in own]
    for counts, cell in zip(own, packed):
        assert len(cell) < 11 * counts.shape[1] and np.array_equal(X._unpack(cell), counts)
    answers = X._answer(pa.table({"part": [0] * 8, "block": range(8), "words": [b""] * 8, "pairs": packed}))
    assert answers["words"].to_pylist() == [X._pack_answer(np.zeros((2, 0), np.uint64))] * 8
    for block, (counts, value) in enumerate(zip(own, answers["pairs"].to_pylist())):
        assert len(value) < counts.shape[1]
        n, places, background, target = X._unpack_answer(value)
        assert n == counts.shape[1] and np.array_equal(counts[0, places], np.sort(shared))
        twice = np.isin(np.sort(shared), shared[:1000])
        assert background.tolist() == (7 + 7 * twice).tolist()
        assert target.tolist() == [int(block != 0)] * 2000
