"""License scan by a positional rare-token index, with DataFrame and SQL operations only.

Templates are statements of licenses; the index posts each of their words at its
places in the templates. The commonest words have no part in the share of a
template that stands in a text, but must stand in its key phrases all the same. Each
template is anchored at the rarest word of its mandatory key phrases, by inverse
document frequency over all documents. Only the templates whose anchors a document has are
looked up: the anchor at template place p and document place d proposes that the template starts at
d - p, which is before the text if the text opens with a later part of it. A
proposed start is an alignment if enough of the template's words stand at their
places after it, among them every word of its mandatory key phrases. An alignment needs its
anchor, so no template is lost.

Base labels need no alignment: they are the places where a phrase's words stand
consecutively. ``labels`` joins both kinds, distinct and sorted. ``score`` is the
largest share of a template's words in an alignment that starts in the text, and 0.5 at
least with a base place or an alignment that starts before the text. Null and empty texts have no words. Every row has a result of its
own, also rows that repeat an id; other columns are not looked at.

A document's words stay in its row; only its license words are kept and
exploded, and votes are counted by document, template and start, which spreads
long documents too.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithogrid.llm.common import Shared, table

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, statement, mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["permission is hereby granted", "free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version", ["apache license"]),
    ("gpl", "licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use", "source and binary forms"]),
    ("mpl", "subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ["permission to use copy modify", "for any purpose"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("boost", "boost software license version", ["boost software license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright", ["waived all copyright"]),
    ("cc-by", "licensed under cc by", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution", ["creative commons attribution"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]
#: Words of the templates that do not count in an alignment's share.
COMMON = "a and any are as for has in into is of or the this to use with all".split()
#: Share of a template's counted words that an alignment needs.
ENOUGH = 0.6

_WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _postings() -> list[tuple[str, int, int, int, int]]:
    """(word, template, place, 1 if in a key phrase, 1 if it counts) of every word that counts or is in a key phrase.

    A common word outside the key phrases has no part in the result.
    """
    posted = []
    for t, (_, statement, phrases) in enumerate(TEMPLATES):
        words = statement.split()
        key = set()
        for phrase in map(str.split, phrases):
            start = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
            key |= set(range(start, start + len(phrase)))
        posted += [(w, t, p, int(p in key), int(w not in COMMON)) for p, w in enumerate(words) if p in key or w not in COMMON]
    return posted


def license_word_list() -> list[str]:
    return sorted({w for w, *_ in _postings()} | set(chain(*map(str.split, BASE))))


def _quoted(word: str) -> str:
    return f"'{word}'"


def license_words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, hits): the license words (w, at) of each document in order."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    # the generator keeps the words from being worked out once for each use
    words = docs.select("doc_id", F.explode(F.array(F.split(lowered, _WORD_BREAK))).alias("split"))
    # a text that starts or ends with other characters has an empty word there
    first = F.expr("if(split[0] = '', 1, 0)")
    last = F.expr("if(size(split) > 1 AND split[size(split) - 1] = '', 1, 0)")
    known = ", ".join(map(_quoted, license_word_list()))
    hits = (f"filter(transform(split, (w, i) -> if(w IN ({known}), named_struct('w', w, 'at', i - if(split[0] = '', 1, 0)), "
            "null)), h -> h IS NOT NULL)")
    return words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.size("split") - first - last).cast("bigint").alias("n_words"), F.expr(hits).alias("hits"))


def _phrase_places(phrase: str) -> Column:
    """Places where the words of a phrase stand consecutively: they are neighbours in ``hits`` too."""
    first, *rest = phrase.split()
    follow = "".join(f" AND get(hits, i + {k}).w <=> {_quoted(w)} AND get(hits, i + {k}).at <=> h.at + {k}"
                     for k, w in enumerate(rest, 1))
    return F.expr(f"transform(filter(hits, (h, i) -> h.w = {_quoted(first)}{follow}), h -> h.at)")


def _ranks(found: DataFrame) -> dict[str, int]:
    """License words by falling inverse document frequency; there are as many as the templates have."""
    total = found.count()
    counts = {r.w: r.docs for r in found.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("docs")).collect()}
    idf = {w: math.log(1 + total / (0.5 + counts.get(w, 0))) for w in license_word_list()}
    return {w: n for n, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}


def _alignments(found: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(row, template, start, share) of every alignment."""
    spark = found.sparkSession
    posted = _postings()
    words, keys = [0] * len(TEMPLATES), [0] * len(TEMPLATES)
    anchors: dict[int, tuple[int, int]] = {}  # template: rank and place of the rarest word of its key phrases
    for w, t, p, key, counts in posted:
        words[t] += counts
        keys[t] += key
        if key:
            anchors[t] = min(anchors.get(t, (len(ranks), 0)), (ranks[w], p))
    index = spark.createDataFrame(
        [(w, t, p, key, counts, words[t], keys[t], anchors[t][0], anchors[t][1] == p) for w, t, p, key, counts in posted],
        "w string, template int, place int, key int, counts int, words int, keys int, anchor int, at_anchor boolean")
    used = {rank for rank, _ in anchors.values()}
    rank = " ".join(f"WHEN {_quoted(w)} THEN {n}" for w, n in ranks.items() if n in used)
    looked_up = F.expr(f"array_compact(transform(array_distinct(hits.w), w -> CASE w {rank} END))")
    # the outer kind of generator keeps the filter from working the array out again
    anchored = found.filter(F.size("hits") > 0).select(
        "row", looked_up.alias("looked_up"), F.explode_outer("hits").alias("h")).filter(F.size("looked_up") > 0)
    votes = anchored.select("row", "looked_up", "h.w", "h.at").join(F.broadcast(index), "w").filter(
        F.array_contains("looked_up", F.col("anchor"))).select(
        "row", "template", (F.col("at") - F.col("place")).alias("start"), "key", "counts", "words", "keys", "at_anchor")
    return votes.groupBy("row", "template", "start", "words", "keys").agg(
        F.sum("counts").alias("n"), F.sum("key").alias("k"), F.max("at_anchor").alias("proposed")).filter(
        f"proposed AND k = keys AND n >= {ENOUGH} * words").select(
        "row", "template", "start", F.when(F.col("start") >= 0, F.col("n") / F.col("words")).otherwise(0.5).alias("share"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, alignments."""
    found = Shared(docs.sparkSession).save(license_words(docs), "license-words")
    label = F.element_at(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("template") + 1)
    aligned = _alignments(found, _ranks(found)).groupBy("row").agg(
        F.array_sort(F.collect_set(label)).alias("own"), F.max("share").alias("share"),
        F.count(F.lit(1)).alias("alignments"))
    bases = found.select("row", "doc_id", "n_words", *[
        _phrase_places(phrase).alias(f"in_{name}") for phrase, name in BASE.items()])
    places = F.concat(*[F.col(f"in_{name}") for name in BASE.values()])
    names = F.array_compact(F.array(*[F.when(F.size(f"in_{name}") > 0, name) for name in sorted(BASE.values())]))
    based = bases.select(
        "row", "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        names.alias("names"))
    none = F.array().cast("array<string>")
    return based.join(aligned, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("names", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("names", F.coalesce("own", none))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("alignments", F.lit(0)).alias("alignments"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
