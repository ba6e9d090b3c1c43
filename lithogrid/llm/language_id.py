"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its
letters' vectors by elementwise product, each rolled by its place from the end,
so order counts. A text's vector bundles (adds) the vectors of all its
n-grams; a language's prototype bundles the unit vectors of its training texts. A text
takes the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; each run of other characters counts as one blank
around words. The vector of a letter is drawn from its code point alone, so no
alphabet is fixed. Prototypes come from at most about ``MAX_PER_LANG`` texts of
each language, chosen by a hash of their ids and bundled in Spark tasks.

A null text and one without a letter give ``und`` with score 0. Languages that
tie go to the first by name. ``lang``, source and id enter no prediction.
Without training texts everything is ``und``. Repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithogrid.llm.common import per_worker, table

DIMENSIONS = 512
GRAM = 3
MAX_PER_LANG = 2000
UNKNOWN = "und"
#: Distinct n-grams whose vectors a worker keeps.
MAX_GRAMS = 30_000
#: Letters that a worker numbers for direct lookup; texts with others take the general way.
NUMBERED = 62
_BITS, _SHORT, _OTHER = 21, 6, 63


class Grams:
    """Vectors of n-grams, made when first needed; emptied when full."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 23):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = 0
        text = points.tobytes().decode("utf-32-le")
        #: 0 for what is no letter, the number of a numbered letter, or _OTHER.
        self.number = np.where(np.fromiter(map(str.isalpha, text), bool, len(text)), _OTHER, 0).astype(np.uint8)
        self.numbered = [0]
        self.clear()

    def clear(self) -> None:
        self.used = 0
        self.vectors = np.empty((MAX_GRAMS, self.dimensions), np.float32)
        self.row = np.full(1 << _SHORT * GRAM, -1, np.int32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= MAX_GRAMS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng((self.seed, code)).choice(
                np.array([-1, 1], np.float32), self.dimensions)
        return self.letters[code]

    def gram(self, points: list[int]) -> np.ndarray:
        """The product of the letters' vectors, each rolled by its place from the end."""
        bound = self.letter(points[-1])
        for place in range(1, len(points)):
            bound = bound * np.roll(self.letter(points[-1 - place]), place)
        return bound

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundled vector of a text, None without a letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        numbers = self.number[points]
        if not numbers.any():
            return None
        if (numbers == _OTHER).any():
            for new in np.unique(points[numbers == _OTHER]).tolist():
                if len(self.numbered) <= NUMBERED:
                    self.number[new] = len(self.numbered)
                    self.numbered.append(new)
            numbers = self.number[points]
            if (numbers == _OTHER).any():
                return self._general(np.where(numbers > 0, points, 0).astype(np.int64))
        codes = self._codes(numbers.astype(np.int32), _SHORT)
        missing = np.unique(codes[self.row[codes] < 0])
        if len(missing):
            if self.used + len(missing) > MAX_GRAMS:
                self.clear()
                missing = np.unique(codes)
                if len(missing) > MAX_GRAMS:
                    return self._general(np.where(numbers > 0, points, 0).astype(np.int64))
            for code in missing.tolist():
                self.vectors[self.used] = self.gram([
                    self.numbered[code >> _SHORT * place & (1 << _SHORT) - 1] for place in reversed(range(GRAM))])
                self.row[code] = self.used
                self.used += 1
        counts = np.bincount(self.row[codes], minlength=self.used)
        some = np.flatnonzero(counts)
        return counts[some].astype(np.float32) @ self.vectors[some]

    def _codes(self, letters: np.ndarray, bits: int) -> np.ndarray:
        """n-grams of the letters with one blank for each run of others, and around the text."""
        blank = np.zeros(1, letters.dtype)
        letters = np.concatenate([blank, letters, blank])
        letters = letters[(letters > 0) | np.concatenate([[True], letters[:-1] > 0])]
        codes = letters[GRAM - 1:].copy()
        for place in range(1, GRAM):
            codes |= letters[GRAM - 1 - place:len(letters) - place] << bits * place
        return codes

    def _general(self, letters: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float32)
        for code, count in zip(*map(np.ndarray.tolist, np.unique(self._codes(letters, _BITS), return_counts=True))):
            total += count * self.gram([code >> _BITS * place & (1 << _BITS) - 1 for place in reversed(range(GRAM))])
        return total


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of unit vectors by language within the task."""
    grams = per_worker("grams", DIMENSIONS, Grams)
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            found = grams.vector(text.as_py())
            if found is not None and (size := np.linalg.norm(found)) > 0:
                key = lang.as_py()
                sums[key] = sums.get(key, 0) + (found / size).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes); as many as the training texts have languages."""
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (
        lang, min(1 << 30, max(1, int((1 << 30) * MAX_PER_LANG / n))))]) if sizes else None
    if limit is None:
        return [], np.empty((0, DIMENSIONS), np.float32)
    chosen = usable.filter(draw < F.element_at(limit, F.col("lang"))).select("lang", "text")
    sums = chosen.mapInArrow(_bundle, "lang string, sums array<double>")
    total = sums.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(
        F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("x"))
    rows = sorted(total.select("lang", F.col("x.x").alias("x")).collect())
    found = np.array([r.x for r in rows], np.float32).reshape(len(rows), -1)
    return [r.lang for r in rows], found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def identifier(spark: SparkSession, langs: list[str], prototypes: np.ndarray):
    """A UDF from text to (lang_pred, score)."""
    sent = spark.sparkContext.broadcast((langs, prototypes))

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, profiles = sent.value
        grams = per_worker("grams", DIMENSIONS, Grams)
        for some in texts:
            out = []
            for text in some:
                found = grams.vector(text) if names else None
                if found is None:
                    out.append((UNKNOWN, 0.0))
                    continue
                cosines = profiles @ found / max(float(np.linalg.norm(found)), 1e-9)
                best = int(cosines.argmax())
                out.append((names[best], float(min(max(cosines[best], 0), 1))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return identify


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    identify = identifier(docs.sparkSession, *train(docs))
    return docs.select("doc_id", held_out().alias("held_out"), identify("text").alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
