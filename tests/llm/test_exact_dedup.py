import re

from pyspark.sql import functions as F

from lithogrid.llm.exact_dedup import exact_dedup, keep_first

TEXTS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (1, "a b "), (4, None), (2, ""), (7, "A b"), (8, "x" * 100_000),
         (6, "x" * 100_000), (10, "a\x0bb"), (11, "a b"), (None, "lone"), (12, "lone"), (None, "nobody")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return sorted(((i, min((x for x in ids if x is not None), default=None), len(ids))
                   for ids in groups.values() for i in ids), key=repr)


def found(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in frame.collect()), key=repr)


def test_groups_match_brute_force(docs_of):
    assert found(exact_dedup(docs_of(TEXTS))) == brute(TEXTS)


def test_texts_with_one_digest_stay_apart(docs_of):
    rows = [(i, f"text {i % 7}" * (1 + i % 3)) for i in range(60)]
    got = exact_dedup(docs_of(rows), digest=lambda norm: (F.length(norm) % 2).cast("string"))
    assert found(got) == brute(rows)


def test_hot_group_and_empty_table(docs_of):
    rows = [(i, "same" if i % 2 else f"own {i}") for i in range(3000)]
    assert found(exact_dedup(docs_of(rows))) == brute(rows)
    assert exact_dedup(docs_of([])).count() == 0


def test_keep_first_leaves_one_row_of_each_text(docs_of):
    docs = docs_of([*TEXTS, (3, "a b"), (3, "a b")]).withColumn("norm", F.lit("own")).withColumn("digest", F.lit(1))
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.norm) for r in kept.filter("doc_id IS NOT NULL").collect()) == [
        (i, "own") for i in (1, 2, 3, 6, 7, 11, 12)]
    assert kept.filter("doc_id IS NULL").count() == 1
