"""Benchmark decontamination: BM25 index of test items, queried by every training passage with block-max WAND.

The index holds units of at most ``UNIT`` consecutive words of the items. A
posting's weight is its BM25 weight, with document frequencies over all items,
divided by the unit's sum of weights, so a passage that has all of a unit's words scores 1.
Units lie in blocks, and each term keeps its largest weight in each block that
it occurs in. Every training text is cut into overlapping passages of ``2 * UNIT``
words; a passage is a query of its distinct words. Block-max WAND first sums the
block maxima of the query's terms and skips every block that cannot reach
``THRESHOLD``; in the others WAND moves its cursors from pivot to pivot and
returns every unit that scores ``THRESHOLD`` or more. A unit's item is then verified on the words around the passage: of the item's
question and of its answer (its last sentences), at least ``OVERLAP`` of the
word ``SHINGLE``-grams must occur there (shorter parts: the part as a whole). Of answers of
fewer than ``SHORT`` words the pairs of words count, and one is enough when at
least ``HIGH`` of the ``SHINGLE``-grams of a question that is no shorter occur.

The index goes to the executors in shards of at most ``SHARD_BYTES`` of item
text, one pass over the texts for each, and the matches of a shard are written
before the next one is built, so its size is bounded for benchmarks of any size. Words are runs of letters and digits, A-Z lower-cased.

Null and empty texts and items match nothing. Repeated items are reported one
by one, repeated rows have equal results, ids may be null. Texts of any length
are searched whole.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithogrid.llm.common import Shared, per_worker, table

UNIT = 64
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
#: Answers of fewer words are judged by their pairs of words.
SHORT = 2 * SHINGLE
#: Overlap of a question that one pair of words of a short answer confirms.
HIGH = 0.8
BLOCK = 4
K1, B = 1.2, 0.75
SHARD_BYTES = 16 << 20
#: Passages that are bounded together.
_PASSAGES = 64
#: Words that the answer, the last sentences of an item, has at least.
ANSWER_WORDS = 5

_TABLE = bytes((i + 32 if 65 <= i <= 90 else i if chr(i).isalnum() or i >= 128 else 32) for i in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return raw.translate(_TABLE).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentences with ANSWER_WORDS words together, the question what comes before, if anything."""
    sentences = [w for w in map(words_of, _SENTENCE.split((text or "").encode())) if w]
    answer: list[bytes] = []
    while sentences and len(answer) < ANSWER_WORDS:
        answer = sentences.pop() + answer
    question = [w for s in sentences for w in s]
    return question or answer, answer


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    n = min(size, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Postings of the units of some items, ready for block-max WAND."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[bytes, int], total: int, mean: float):
        self.parts, self.units = [], []
        idf = {w: math.log(1 + (total - n + .5) / (n + .5)) for w, n in frequency.items()}
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for number, (item, text) in enumerate(items):
            words = words_of(text)
            question, answer = question_and_answer(text)
            short = len(answer) < SHORT
            self.parts.append((item, len(words), shingles(question), shingles(answer, 2 if short else SHINGLE),
                               short and len(question) >= max(SHINGLE, len(answer))))
            pieces = max(1, -(-len(words) // UNIT))
            for k in range(pieces):
                unit = words[len(words) * k // pieces:len(words) * (k + 1) // pieces]
                if not unit:
                    continue
                counts: dict[bytes, int] = {}
                for w in unit:
                    counts[w] = counts.get(w, 0) + 1
                norm = K1 * (1 - B + B * len(unit) / mean)
                weights = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in counts.items()}
                whole = sum(weights.values())
                for w, x in weights.items():
                    postings.setdefault(w, []).append((len(self.units), x / whole))
                self.units.append(number)
        self.terms = {w: n for n, w in enumerate(postings)}
        self.docs = [[d for d, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        #: Each term's blocks of units with its largest weight there, one term after the other.
        best = [{} for _ in self.docs]
        for blocks, docs, weights in zip(best, self.docs, self.weights):
            for d, x in zip(docs, weights):
                blocks[d // BLOCK] = max(x, blocks.get(d // BLOCK, 0.0))
        self.first = np.cumsum([0, *map(len, best)])
        self.block = np.array([b for blocks in best for b in blocks], np.int64)
        self.block_max = np.array([x for blocks in best for x in blocks.values()])
        self.blocks = len(self.units) // BLOCK + 1
        self.most = np.array([max(w) for w in self.weights])

    def live_blocks(self, terms: np.ndarray, halves: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(passage, its distinct terms, blocks whose units may score THRESHOLD) for the halves' terms, -1 for other words.

        A block's bound is the sum of the terms' largest weights in it.
        """
        for start in range(0, max(1, halves - 1), _PASSAGES):
            count = min(_PASSAGES, max(1, halves - 1) - start)
            words = terms[start * UNIT:(start + count + 1) * UNIT]
            half = np.arange(len(words)) // UNIT
            half, words = half[words >= 0], words[words >= 0]
            key = np.unique(np.concatenate([half, half - 1]) * len(self.docs) + np.concatenate([words, words]))
            key = key[(key >= 0) & (key < count * len(self.docs))]
            passage, term = key // len(self.docs), key % len(self.docs)
            size = self.first[term + 1] - self.first[term]
            at = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
            bound = np.bincount(np.repeat(passage, size) * self.blocks + self.block[at], self.block_max[at],
                                count * self.blocks).reshape(count, self.blocks)
            live = bound >= THRESHOLD - 1e-9
            ends = np.searchsorted(passage, np.arange(count + 1))
            for k in np.flatnonzero(live.any(1)).tolist():
                yield start + k, term[ends[k]:ends[k + 1]], np.flatnonzero(live[k]).tolist()

    def retrieve(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """(unit, score) of the block's units that score THRESHOLD or more for the distinct terms, by WAND."""
        least, found, stop = THRESHOLD - 1e-9, [], (block + 1) * BLOCK
        at, active = {}, []
        for t in terms:
            docs = self.docs[t]
            at[t] = bisect_left(docs, block * BLOCK)
            if at[t] < len(docs) and docs[at[t]] < stop:
                active.append((docs[at[t]], t))
        while active:
            active.sort()
            bound, pivot = 0.0, 0
            for pivot, (_, t) in enumerate(active):
                bound += self.most[t]
                if bound >= least:
                    break
            else:
                break
            doc = active[pivot][0]
            while pivot + 1 < len(active) and active[pivot + 1][0] == doc:
                pivot += 1
            front, active = active[:pivot + 1], active[pivot + 1:]
            target = doc
            if front[0][0] == doc:
                score = sum(self.weights[t][at[t]] for _, t in front)
                if score >= least:
                    found.append((doc, score))
                target = doc + 1
            for d, t in front:
                docs, i = self.docs[t], at[t]
                while i < len(docs) and docs[i] < target:
                    i += 1
                at[t] = i
                if i < len(docs) and docs[i] < stop:
                    active.append((docs[i], t))
        return found

    def search(self, text: str | None) -> list[tuple[int | None, int, float, float, float]]:
        """(item, first word of the passage, score, question overlap, answer overlap) of each verified item."""
        words = words_of(text)
        if not len(words) or not len(self.units):
            return []
        get = self.terms.get  # -1 for words that no item has
        terms = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        best: dict[int, tuple[float, int, float, float]] = {}
        for k, query, blocks in self.live_blocks(terms, -(-len(words) // UNIT)):
            query = query.tolist()
            seen: dict[tuple[int, int], set] = {}  # n-grams around the passage, by the item's length
            for unit, score in chain.from_iterable(self.retrieve(query, b) for b in blocks):
                number = self.units[unit]
                item, length, question, answer, alone = self.parts[number]
                if number in best and best[number][0] >= score:
                    continue
                shares = []
                for part in (question, answer):
                    n = len(next(iter(part), ()))
                    if n and (length, n) not in seen:
                        near = words[max(0, k * UNIT - length):(k + 2) * UNIT + length]
                        seen[length, n] = set(zip(*(near[i:] for i in range(n))))
                    shares.append(len(part & seen[length, n]) / len(part) if n else 0.0)
                if min(shares) >= OVERLAP or alone and shares[0] >= HIGH and shares[1] > 0:
                    best[number] = (score, k * UNIT, *shares)
        return [(self.parts[n][0], at, score, q, a) for n, (score, at, q, a) in sorted(best.items())]


_MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("passage", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _distinct_words(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(words_of(t))) for t in texts])


@F.pandas_udf(T.LongType())
def _count_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t)) for t in texts], dtype="int64")


def _searcher(sent: Broadcast) -> Callable[[str], Column]:
    key = uuid.uuid4().hex

    @F.pandas_udf(_MATCH)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = per_worker("benchmark-index", key, lambda: Index(*sent.value))
        for some in texts:
            yield pd.Series([[dict(zip(("item_id", "passage", "score", "question_overlap", "answer_overlap"), m))
                              for m in index.search(t)] for t in some], dtype=object)

    return search


def matches(shared: Shared, benchmark: DataFrame, found: Callable[[Callable], DataFrame],
            single: Callable[[Callable], DataFrame] | None = None) -> DataFrame:
    """The union over the shards of the benchmark of what ``found`` makes of a UDF from text to verified items.

    With several shards each result is written, and its broadcast let go, before the next shard is built;
    with one it is what ``single`` makes, if that is given.
    """
    items = shared.save(benchmark.select(
        "item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    total, size, words = items.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.sum(_count_words("text"))).first()
    shards = max(1, -(-size // SHARD_BYTES))
    per_word = shared.save(items.select("row", F.explode(_distinct_words("text")).alias("word")), "item-words")
    frequency = per_word.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    made = None
    for k in range(shards):
        own = items.filter(shard == k)
        used = per_word.filter(shard == k).select("word").distinct()
        counts = {bytes(r.word): r.n for r in frequency.join(used, "word", "left_semi").collect()}
        rows = [(r.item_id, r.text) for r in own.orderBy("row").collect()]
        units = max(1.0, (words or 0) / max(1, total))
        sent = shared.spark.sparkContext.broadcast((rows, counts, total, min(units, float(UNIT))))
        if shards == 1:
            return (single or found)(_searcher(sent))
        some = found(_searcher(sent))
        some = shared.save(some, f"found-{k}")
        sent.destroy()
        made = some if made is None else made.unionAll(some)
    return made


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and verified item: doc_id, item_id, passage, score, question_overlap, answer_overlap."""
    return matches(Shared(docs.sparkSession), benchmark, lambda search: docs.select(
        "doc_id", search("text").alias("found")).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified item, with all their columns."""
    shared, numbered = Shared(docs.sparkSession), []

    def hits(search: Callable) -> DataFrame:
        """Numbers of the rows with a verified item; the rows are written once, so that every pass has the same numbers."""
        if not numbered:
            numbered.append(shared.save(docs.select(
                F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered"))
        return numbered[0].select("number", search("row.text").alias("found")).filter(F.size("found") > 0).select("number")

    def clean(search: Callable) -> DataFrame:
        packed = docs.select(F.struct("*").alias("row"), search("text").alias("found"))
        return packed.filter(F.size("found") == 0).select("row.*")

    kept = matches(shared, benchmark, hits, clean)
    return numbered[0].join(kept, "number", "left_anti").select("row.*") if numbered else kept


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
