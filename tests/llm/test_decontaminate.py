import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithogrid.llm import decontaminate as X


def made_up(rng, count):
    return " ".join("".join(rng.choices("th an er in ou st".split(), k=rng.randint(1, 4))) for _ in range(count)) + "."


def index_of(items):
    frequency = {}
    for _, t in items:
        for w in set(X.words_of(t)):
            frequency[w] = frequency.get(w, 0) + 1
    return X.Index(items, frequency, len(items), 30.0)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_wand_finds_what_scoring_every_unit_finds(monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    rng = random.Random(block)
    items = [(i, made_up(rng, rng.choice([1, 8, 30, 150]))) for i in range(120)]
    index = index_of(items)
    table = {}
    for t, (docs, weights) in enumerate(zip(index.docs, index.weights)):
        for d, w in zip(docs, weights):
            table.setdefault(d, {})[t] = w
    hits = 0
    for threshold in (.1, .3, .5, .9):
        monkeypatch.setattr(X, "THRESHOLD", threshold)
        for _ in range(60):
            source = X.words_of(rng.choice(items)[1])[:64]
            words = rng.sample(source, rng.randint(0, min(44, len(source)))) + X.words_of(made_up(rng, 20))
            terms = sorted({index.terms[w] for w in words if w in index.terms})
            want = {d: sum(ws.get(t, 0) for t in terms) for d, ws in table.items()}
            want = {d: s for d, s in want.items() if s >= threshold - 1e-9}
            halves = np.full(X.UNIT, -1)
            halves[:len(terms)] = terms[:X.UNIT]
            assert len(terms) <= X.UNIT
            got = {}
            for passage, query, blocks in index.live_blocks(halves, 1):
                assert passage == 0 and query.tolist() == terms
                for block in blocks:
                    got |= dict(index.retrieve(query.tolist(), block))
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)
            hits += len(got)
    assert hits > 500


def test_passages_of_a_long_text_are_bounded_alike_in_any_batch(monkeypatch):
    rng = random.Random(5)
    index = index_of([(i, made_up(rng, 20)) for i in range(50)])
    words = X.words_of(" ".join(made_up(rng, 300) + " " + made_up(random.Random(5), 20) for _ in range(12)))
    terms = np.array([index.terms.get(w, -1) for w in words])
    seen = []
    for batch in (64, 5, 1):
        monkeypatch.setattr(X, "_PASSAGES", batch)
        seen.append([(k, q.tolist(), b) for k, q, b in index.live_blocks(terms, -(-len(terms) // X.UNIT))])
    assert seen[0] and seen[0] == seen[1] == seen[2]
    for k, query, _ in seen[0]:
        assert query == sorted({t for t in terms[k * X.UNIT:(k + 2) * X.UNIT].tolist() if t >= 0})


def test_planted_items_are_found_and_clean_texts_left_alone(spark, docs_of, monkeypatch):
    rng = random.Random(7)
    items = [(i, ". ".join(made_up(rng, rng.randint(6, 25)) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    items += [(40, made_up(rng, 400)), (41, None), (42, ""), (43, items[3][1])]
    docs, want = [], set()
    for i in range(120):
        text = made_up(rng, rng.choice([0, 20, 300]))
        if i % 3 == 0:
            n = i // 3
            text += " " + items[n][1].upper().replace(" ", "\n", 3) + " " + made_up(rng, 100)
            want |= {(i, n), (i, 43)} if n == 3 else {(i, n)}
        docs.append((i, text))
    docs += [(200, made_up(rng, 5000) + items[40][1]), (201, None), (202, " "), (None, items[5][1]),
             (203, X.question_and_answer(items[0][1])[0] and items[0][1].split(".")[0])]
    want |= {(200, 40), (None, 5)}
    if len(items[0][1].split(". ")) == 1:
        want.add((203, 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (X.SHARD_BYTES, 2000):  # one shard, and several
        monkeypatch.setattr(X, "SHARD_BYTES", size)
        got = {(r.doc_id, r.item_id) for r in X.contaminated(docs_of(docs), benchmark).collect()}
        assert got == want
    kept = X.keep_clean(docs_of(docs).withColumn("found", F.lit("own")), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert kept.columns[-1] == "found"
    assert X.contaminated(docs_of(docs), benchmark.limit(0)).count() == 0
    assert X.contaminated(docs_of([]), benchmark).count() == 0


def test_short_answers_that_differ():
    rng = random.Random(9)
    question, answer = made_up(rng, 30)[:-1], "one two three four five"
    index = index_of([(1, f"{question}. {answer}.")] + [(i, made_up(rng, 30)) for i in range(2, 30)])
    before, after = made_up(rng, 50), made_up(rng, 50)
    for tail in (answer, "one two other four five", "one two three", "one two", "three four and no more"):
        assert [m[0] for m in index.search(f"{before} {question}. {tail}. {after}")] == [1], tail
    assert index.search(f"{before} {question}. {after}") == []
    assert index.search(f"{before} {' '.join(question.split()[:12])}. {after}") == []


def test_a_match_does_not_depend_on_other_items():
    """A window is as wide as its own item: a long item that is looked at before does not widen it."""
    rng = random.Random(11)
    question, answer = made_up(rng, 40)[:-1], made_up(rng, 20)[:-1]
    long_item = made_up(rng, 600)
    short = (2, f"{question}. {answer}.")
    text = f"{long_item[:200]} {question}. {made_up(rng, 350)} {answer}. {long_item[200:400]}"
    near = f"{question}. {answer}."
    others = [(i, made_up(rng, 30)) for i in range(10, 30)]
    for items in ([short, *others], [(1, long_item), short, *others], [short, *others, (99, long_item)]):
        index = index_of(items)
        assert 2 not in [m[0] for m in index.search(text)]
        assert 2 in [m[0] for m in index.search(near)]
