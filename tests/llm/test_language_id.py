import random
import zlib

import numpy as np
import pytest

from lithogrid.llm import language_id as X

SYLLABLES = {"en": "the and ing er on th wh".split(), "de": "der sch ung ein zu keit ä".split(),
             "fr": "le eau ment oi é que ç".split()}


def corpus(count, seed):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang)
            for i in range(count) for lang in [rng.choice(sorted(SYLLABLES))]]


def brute(text, grams):
    """Letter by letter, from the letters' vectors alone."""
    blanked, last = [], None
    for c in f"\n{text or ''}\n".lower():
        c = c if c.isalpha() else None
        if c is not None or last is not None or not blanked:
            blanked.append(0 if c is None else ord(c))
        last = c
    if not any(blanked):
        return None
    total = np.zeros(grams.dimensions)
    for i in range(len(blanked) - 2):
        a, b, c = (grams.letter(x) for x in blanked[i:i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


@pytest.mark.parametrize("text", [None, "", "12 .,", "a", "Ab, c.", "  the Éàn... ß  x1y ", "日本 語テスト", "İı ǅ \ud800 a",
                                  "".join(map(chr, range(0x4e00, 0x4f00))) + "abc", "word " * 30_000])
def test_vectors(text):
    grams = X.Grams()
    for _ in range(2):
        got, want = grams.vector(text), brute(text, grams)
        assert (got is None) == (want is None)
        assert got is None or np.allclose(got, want)


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(X, "MAX_GRAMS", 40)
    grams = X.Grams()
    for text in ["the quick brown fox jumps over the lazy dog", "abc abc", "sphinx of black quartz judge my vow", "a b"]:
        assert np.allclose(grams.vector(text), brute(text, grams))


def test_held_out_accuracy(spark):
    rows = [(i, t, lang, "s") for i, t, lang in corpus(600, 1)]
    rows += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123 !", None, "s"), (None, "the and ing", "en", "s"),
             (3, "der sch", "xx", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn(
        "score", __import__("pyspark").sql.functions.lit("own"))
    got = X.language_id(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows[:600]}
    tested = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert len(tested) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > .97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert X.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in X.language_id(docs.withColumn("lang", docs.source.substr(5, 1)).filter("doc_id IS NULL")).collect()} == {"und"}
