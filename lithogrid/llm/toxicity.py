"""Toxicity scores by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of the embeddings of its hashed pieces: the word,
its first and its last ``AFFIX`` bytes. Filters of several widths slide over
the words, each filter's largest response over the whole text is kept, and a
logistic layer weighs these maxima. Training is Adam on a bounded sample of
labelled rows; thresholds are calibrated on a part of them that the weights
never saw.

Thresholds differ by language, but the ``lang`` column never enters a score:
the language is one of ``KINDS`` classes told from the text's own commonest
short words, whose shares by language are counted in the training texts. A
score is moved so that the threshold of its class becomes 0.5.

Null and empty texts have no words; their score is what the bias gives. Ties,
repeated rows and other columns do not matter: a score depends on the text.
Without a label of either kind, every score is the share of toxic labels, below 0.5.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithogrid.llm.common import per_worker, table

#: Labelled rows that training takes at most, and their bytes at most; of larger sets, those with the smallest hashes.
MAX_ROWS = 6000
MAX_BYTES = 48 << 20
BUCKETS = 1 << 18
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
AFFIX = 4
EPOCHS = 10
MAX_WORDS = 200_000
COMMON_WORDS = 200

#: ASCII but letters and digits separates words; letters are lower-cased.
_TABLE = bytes((i + 32 if 65 <= i <= 90 else i if chr(i).isalnum() or i >= 128 else 32) for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _pieces(word: bytes) -> tuple[int, int, int]:
    return (zlib.crc32(word) % BUCKETS, zlib.crc32(word[:AFFIX], 1) % BUCKETS, zlib.crc32(word[-AFFIX:], 2) % BUCKETS)


class Words(dict):
    """Words to numbers, and for each number a row of ``rows``; emptied when full.

    ``make`` gives the rows of new words.
    """

    def __init__(self, make):
        self.make, self.new, self.rows = make, [], None

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.new.append(word)
        return found

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, words in each text)."""
        if len(self) > MAX_WORDS:
            self.clear()
            self.rows = None
        split = map(words_of, texts)
        found = [np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)) for ws in split]
        sizes = np.array([len(r) for r in found], np.int64)
        if self.new or self.rows is None:
            more, self.new = self.make(self.new), []
            self.rows = more if self.rows is None else np.concatenate([self.rows, more])
        return np.concatenate([np.empty(0, np.int64), *found]), sizes


def piece_rows(words: list[bytes]) -> np.ndarray:
    return np.array([_pieces(w) for w in words], np.int64).reshape(-1, 3)


class Network:
    """Embeddings, filters by width, and the logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, .1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.filters = [rng.normal(0, .3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, .3, (len(WIDTHS), FILTERS)).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.base]

    def maxima(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each text, and the place of it. x: a vector for each word."""
        count = len(sizes)
        best = np.zeros((count, len(WIDTHS), FILTERS), np.float32)
        where = np.full(best.shape, -1, np.int64)
        starts = np.cumsum(sizes) - sizes
        each = x @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], 1)
        for k, w in enumerate(WIDTHS):
            some = np.flatnonzero(sizes >= w)
            if not len(some):
                continue
            n, first = len(x) - w + 1, FILTERS * sum(WIDTHS[:k])
            response = each[:n, first:first + FILTERS] + self.bias[k]
            for j in range(1, w):
                response += each[j:j + n, first + FILTERS * j:first + FILTERS * (j + 1)]
            # a text's windows end w - 1 words before it does; those across texts are left out
            ends = starts[some] + sizes[some] - w + 1
            cuts = np.stack([starts[some], ends], 1).ravel()
            padded = np.concatenate([response, np.full((1, FILTERS), -np.inf, np.float32)])
            best[some, k] = np.maximum.reduceat(padded, np.minimum(cuts, n), axis=0)[::2]
            if self.trace:
                for d in some:
                    where[d, k] = starts[d] + response[starts[d]:starts[d] + sizes[d] - w + 1].argmax(0)
        return best, where

    trace = False

    def logits(self, best: np.ndarray) -> np.ndarray:
        return (np.maximum(best, 0) * self.out).sum((1, 2)) + self.base[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(net: Network, numbers: np.ndarray, sizes: np.ndarray, pieces: np.ndarray, labels: np.ndarray, seed: int = 6):
    """Adam on mini-batches; gradients reach the words at the maxima only."""
    rng = np.random.default_rng(seed)
    starts = np.cumsum(sizes) - sizes
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    weight = np.where(labels, .5 / max(labels.mean(), 1e-3), .5 / max(1 - labels.mean(), 1e-3)) ** .5
    step = 0
    net.trace = True
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            some = order[at:at + 64]
            spans = [np.arange(starts[d], starts[d] + sizes[d]) for d in some]
            ids = numbers[np.concatenate(spans)] if spans else numbers[:0]
            x = net.embed[pieces[ids]].sum(1) if len(ids) else np.zeros((0, DIMENSIONS), np.float32)
            best, where = net.maxima(x, sizes[some])
            keep = rng.random(best.shape) > .2
            active = np.maximum(best, 0) * keep
            p = _sigmoid((active * net.out).sum((1, 2)) + net.base[0])
            err = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            grads = [np.zeros_like(q) for q in net.params()[1:]]
            g_filters, g_bias, touched, pulls = grads[:len(WIDTHS)], grads[-3], [], []
            grads[-2][:] = np.tensordot(err, active, 1) + 1e-4 * net.out
            grads[-1][0] = err.sum()
            back = err[:, None, None] * net.out * keep * (best > 0) * (where >= 0)
            for k, w in enumerate(WIDTHS):
                d, f = np.nonzero(back[:, k])
                g, spot = back[d, k, f], where[d, k, f]
                np.add.at(g_bias[k], f, g)
                for j in range(w):
                    np.add.at(g_filters[k][j].T, f, g[:, None] * x[spot + j])
                    touched.append(pieces[ids[spot + j]].ravel())
                    pulls.append(np.repeat(g[:, None] * net.filters[k][j].T[f], 3, axis=0))
            step += 1
            rate = .01 * np.sqrt(1 - .999 ** step) / (1 - .9 ** step)
            rows, at_row = np.unique(np.concatenate(touched), return_inverse=True)
            pull = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(pull, at_row, np.concatenate(pulls))
            (m, v), *others = moments  # rows without a gradient rest
            m[rows] += .1 * (pull - m[rows])
            v[rows] += .001 * (pull ** 2 - v[rows])
            net.embed[rows] -= rate * (m[rows] / (np.sqrt(v[rows]) + 1e-8) + .01 * net.embed[rows])
            for q, g, (m, v) in zip(net.params()[1:], grads, others):
                m += .1 * (g - m)
                v += .001 * (g * g - v)
                q -= rate * m / (np.sqrt(v) + 1e-8)
    net.trace = False


class Model:
    """A trained network, the language classes and their thresholds."""

    def __init__(self, net: Network | None, share: float, common: dict[bytes, np.ndarray], cuts: np.ndarray):
        self.net, self.share, self.common, self.cuts = net, share, common, cuts

    def state(self) -> tuple:
        weights = None if self.net is None else self.net.params()
        return weights, self.share, self.common, self.cuts

    @classmethod
    def of(cls, state: tuple) -> Model:
        weights, *rest = state
        net = None
        if weights is not None:
            net = Network.__new__(Network)
            net.embed, *net.filters, net.bias, net.out, net.base = weights
        return cls(net, *rest)

    def words(self) -> Words:
        """A word's row is its vector and what it says for each language class."""
        none = np.zeros(len(self.cuts), np.float32)

        def rows(words: list[bytes]) -> np.ndarray:
            vectors = self.net.embed[piece_rows(words)].sum(1)
            return np.concatenate([vectors, np.array(
                [self.common.get(w, none) for w in words], np.float32).reshape(-1, len(none))], 1)

        return Words(rows)

    def judge(self, texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(probability, language class whose common words fit best) of each text."""
        numbers, sizes = words.of(texts)
        rows = words.rows[numbers]
        p = _sigmoid(self.net.logits(self.net.maxima(np.ascontiguousarray(rows[:, :DIMENSIONS]), sizes)[0]))
        sums = np.concatenate([np.zeros((1, len(self.cuts))), np.cumsum(rows[:, DIMENSIONS:], 0, dtype=np.float64)])
        ends = np.cumsum(sizes)
        return p, (sums[ends] - sums[ends - sizes]).argmax(1)

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), min(self.share, .49))
        raw, kind = self.judge(texts, words)
        cut = self.cuts[kind]
        return np.where(raw >= cut, .5 + .5 * (raw - cut) / np.maximum(1 - cut, 1e-9), .5 * raw / cut).clip(0, 1)


def _common_words(texts: list[str | None], langs: list[str | None]) -> tuple[dict[bytes, np.ndarray], list[str]]:
    """For the commonest words of each language, the logarithm of its share there."""
    names = sorted({x for x in langs if x is not None}) or ["und"]
    counts: dict[bytes, np.ndarray] = {}
    for text, lang in zip(texts, langs):
        if lang is not None:
            for word in words_of(text):
                if len(word) <= 6:
                    counts.setdefault(word, np.zeros(len(names)))[names.index(lang)] += 1
    total = sum(counts.values(), np.ones(len(names)))
    top = {w for k in range(len(names)) for w in sorted(counts, key=lambda w: (-counts[w][k] / total[k], w))[:COMMON_WORDS]}
    return {w: np.log((counts[w] + .5) / total) - np.log((counts[w] + .5) / total).mean() for w in top}, names


def _threshold(raw: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(raw, kind="stable")
    r, y = np.concatenate([[0], raw[order], [1]]), labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (~y).sum() - np.concatenate([[0], np.cumsum(~y)])
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(r[best + 1] - r[best])]
    return float(np.clip((r[at] + r[at + 1]) / 2, .02, .98))


def fit(texts: list[str | None], langs: list[str | None], labels: np.ndarray) -> Model:
    """Train on three quarters of the rows, calibrate on the rest."""
    labels = np.asarray(labels, bool)
    common, names = _common_words(texts, langs)
    cuts = np.full(len(names), .5)
    if not labels.any() or labels.all():
        return Model(None, float(labels.mean()) if len(labels) else 0.0, common, cuts)
    rest = np.arange(len(labels)) % 4 == 3
    words, net = Words(piece_rows), Network()
    kept = np.flatnonzero(~rest)
    numbers, sizes = words.of([texts[i] for i in kept])
    pieces = words.rows
    del words
    _train(net, numbers, sizes, pieces, labels[kept].astype(np.float32))
    model = Model(net, float(labels.mean()), common, cuts)
    checked = np.flatnonzero(rest)
    judging = model.words()
    parts = [model.judge([texts[i] for i in checked[at:at + 200]], judging) for at in range(0, max(1, len(checked)), 200)]
    raw, kind = (np.concatenate(x) for x in zip(*parts))
    overall = _threshold(raw, labels[checked])
    for k in range(len(names)):
        own = kind == k
        cuts[k] = _threshold(raw[own], labels[checked][own]) if own.sum() >= 100 and labels[checked][own].sum() >= 5 else overall
    return model


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample: labelled rows outside the held-out fifth, with the smallest hashes of their ids.

    Rows are chosen by their ids and sizes before any text moves: texts over a
    hundredth of MAX_BYTES are left out, the others are taken until MAX_ROWS or
    MAX_BYTES are reached. Rows with the same id and text count once.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").filter(~held_out())
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = known.orderBy(order, "toxic").limit(MAX_ROWS).dropDuplicates(["doc_id"])
    keyed = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("digest"))
    sizes = keyed.select("doc_id", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(
        F.broadcast(chosen), "doc_id").filter(F.col("size") <= MAX_BYTES // 100).dropDuplicates(["doc_id", "digest"])
    first = sizes.orderBy(order, "size", "digest").limit(MAX_ROWS)
    total = F.sum("size").over(Window.orderBy(order, "size", "digest"))  # at most MAX_ROWS rows without their texts
    picked = first.withColumn("total", total).filter(F.col("total") <= MAX_BYTES).select("doc_id", "digest", "toxic")
    return keyed.join(F.broadcast(picked), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).drop("digest")


def _fit_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    per_worker("training", 0, object)  # lets go of what the worker kept
    rows = pd.concat([pd.DataFrame(columns=["lang", "text", "toxic"]), *batches])
    model = fit(rows["text"].tolist(), rows["lang"].tolist(), rows["toxic"].to_numpy() == 1)
    yield pd.DataFrame({"model": [pickle.dumps(model.state())]})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit in one task, which holds the bounded sample; the driver gets the weights only."""
    sample = training_rows(docs, labels).select("lang", "text", "toxic").repartition(1)
    found = sample.mapInPandas(_fit_in_task, "model binary").collect()
    return Model.of(pickle.loads(found[0].model)) if found else fit([], [], np.zeros(0))


def scorer(spark: SparkSession, model: Model):
    """A UDF from text to score."""
    # plain values, not the class: executors need no copy of this package
    sent, key = spark.sparkContext.broadcast(model.state()), uuid.uuid4().hex

    def made() -> tuple:
        own = Model.of(sent.value)
        return own, own.words()

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, words = per_worker("toxicity", key, made)
        for some in texts:
            rows, held, size, found = some.tolist(), [], 0, []
            for text in rows:
                held.append(text)
                size += len(text or "")
                if size > 1 << 20:
                    found.append(own.scores(held, words))
                    held, size = [], 0
            if held:
                found.append(own.scores(held, words))
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score = scorer(docs.sparkSession, train(docs, labels))
    packed = docs.select(F.struct("*").alias("row"), score("text").alias("score"))
    return packed.filter("score < 0.5").select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
