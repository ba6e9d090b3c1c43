import random
import zlib

import numpy as np
import pytest

from lithogrid.llm import toxicity as X

WORDS = {"en": "the of and in thing reason that erring".split(), "de": "der und die einheit zu lichkeit".split()}
BAD = {"en": ["idiot", "moron"], "de": ["loweiung", "loweisch", "loweient"]}


def corpus(count, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(["en", "de"])
        words = ["".join(rng.choices(WORDS[lang], k=rng.randint(1, 2))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < .2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_learns_and_scores_whole_texts():
    rows = corpus(1500, 1)
    model = X.fit([r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows]) == 1)
    test = corpus(400, 2)
    scores = model.scores([r[1] for r in test], model.words())
    assert np.mean((scores >= .5) == np.array([r[3] for r in test])) > .97
    clean = " ".join(WORDS["en"]) + " "
    late = model.scores([clean * 2000, clean * 2000 + "idiot", None, "", " .. "], model.words())
    assert late[0] < .5 <= late[1] and (late[2:] < .5).all()
    assert ((scores >= 0) & (scores <= 1)).all()


def test_one_text_scores_alike_in_any_company():
    rows = corpus(300, 3)
    model = X.fit([r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows]) == 1)
    texts = [r[1] for r in rows[:40]] + ["", "one", "two words"]
    together = model.scores(texts, model.words())
    alone = [model.scores([t], model.words())[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_kind_of_label_only(toxic):
    model = X.fit(["a b", "c"], ["en", None], np.array([toxic, toxic]) == 1)
    assert (model.scores(["a", None], {}) < .5).all()


def test_query_rows(spark, docs_of):
    rows = corpus(400, 4)
    docs = docs_of([(i, t) for i, t, *_ in rows] + [(1000, None), (1001, ""), (3, "again"), (None, "no id")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(None, 0, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert r.predicted == (r.score >= .5) and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    sample = X.training_rows(docs, labels)
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in sample.toPandas()["doc_id"])
    kept = X.keep_clean(docs.withColumn("score", docs.lang), labels)
    assert kept.columns[-1] == "score" and kept.count() == sum(r.predicted == 0 for r in got)
    none = X.toxicity(docs_of([]), labels.limit(0))
    assert none.count() == 0


def test_a_huge_text_does_not_empty_the_sample(spark, docs_of, monkeypatch):
    """The bound counts what is taken; a text over a hundredth of it is left out, and repeated rows count once."""
    monkeypatch.setattr(X, "MAX_BYTES", 100_000)
    rows = [(i, f"text {i}") for i in range(60)]
    first = min((i for i, _ in rows if zlib.crc32(str(i).encode()) % 5), key=lambda i: i)
    docs = docs_of([(i, "x" * 200_000 if i == first else t) for i, t in rows] + [(7, "text 7")] * 5 + [(9, None), (9, None)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = sorted(map(repr, ((r.doc_id, r.text) for r in X.training_rows(docs, labels).collect())))
    want = {(i, t) for i, t in rows if i != first} | {(9, None)}
    assert got == sorted(map(repr, (w for w in want if zlib.crc32(str(w[0]).encode()) % 5)))
    monkeypatch.setattr(X, "MAX_BYTES", 40 * 100)
    assert X.training_rows(docs_of([(i, "y" * 40) for i in range(300)]), spark.createDataFrame(
        [(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")).count() == 100


def test_workers_need_no_copy_of_the_package(spark, docs_of):
    model = X.fit(["a b", "c"], ["en", None], np.array([True, False]))
    from pyspark import cloudpickle

    assert b"lithogrid" not in cloudpickle.dumps(model.state())
    assert docs_of([(1, "a b")]).select(X.scorer(spark, model)("text")).first()[0] == pytest.approx(float(model.scores(["a b"], model.words())[0]))
