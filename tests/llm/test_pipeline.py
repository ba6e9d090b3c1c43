import random

import corpus_pipeline
from lithogrid.llm import toxicity
from lithogrid.llm.common import table
from .test_decontaminate import made_up
from .test_exact_dedup import brute as exact_groups
from .test_simhash import brute as near_groups
from .test_simhash import slow_fingerprint


def test_stages_take_effect_on_what_the_one_before_kept(spark, docs_of, sf_dir_of, monkeypatch):
    rng = random.Random(11)
    items = [(i, made_up(rng, 20) + " " + made_up(rng, 12)) for i in range(6)]
    rows = []
    for i in range(0, 900, 2):
        rows.append((i, made_up(rng, rng.randint(30, 90)) + (" idiot moron" if i % 6 == 0 else "")))
    rows += [(901, rows[1][1]), (903, "  " + rows[1][1].replace(" ", "  ")), (1, rows[4][1])]       # copies
    base = rows[7][1] + " " + made_up(rng, 900)
    rows += [(905, base), (907, base.replace(" ", " extra ", 1)), (None, base)]
    rows += [(909 + 2 * k, f"{made_up(rng, 60)} {items[k][1]} {made_up(rng, 60)}") for k in range(6)]  # leaks
    rows += [(1001, None), (1003, ""), (1003, ""), (5, rows[2][1] + " clean")]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 900, 2)]
    d = sf_dir_of(documents=docs_of(rows).coalesce(2), benchmark=spark.createDataFrame(items, "item_id long, text string"),
                  labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept, docs = [], table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.Shared(spark).save(stage(spark, docs, d), name)
        kept.append((name, [(r.doc_id, getattr(r, "text", None)) for r in before.collect()], docs))
        if name != "packing":
            assert docs.columns == table(spark, d, "documents").columns
    stages = {name: (before, [(r.doc_id, r.text) for r in after.collect()] if name != "packing" else after)
              for name, before, after in kept}

    before, after = stages["toxicity"]
    judged = toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")).collect()
    assert sorted(str(i) for i, _ in after) == sorted(str(r.doc_id) for r in judged if not r.predicted)
    bad = {i for i, t in before if " idiot" in (t or "")}
    assert len(bad - {i for i, _ in after}) > .9 * len(bad)
    assert len(after) > .98 * (len(before) - len(bad))
    before, after = stages["exact_dedup"]
    assert {i for i, _ in after} == {keep for _, keep, _ in exact_groups(before)}
    assert len(after) == len({keep for _, keep, _ in exact_groups(before)})
    before, after = stages["near_dedup"]
    near = near_groups([(i, slow_fingerprint(t)) for i, t in before if i is not None])
    assert sorted(i for i, _ in after if i is not None) == sorted(set(near.values()))
    before, after = stages["decontamination"]
    leaked = {i for i, t in before if any(text in (t or "") for _, text in items)}
    assert len(leaked) == 6 and {i for i, _ in after} == {i for i, _ in before} - leaked
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in before}
    assert corpus_pipeline.run(spark, d).count() == after.count()


def test_empty_tables(spark, docs_of, sf_dir_of):
    d = sf_dir_of(documents=docs_of([]), benchmark=spark.createDataFrame([], "item_id long, text string"),
                  labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, d).count() == 0
