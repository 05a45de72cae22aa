"""Language of a text: words first, then shorter and shorter character n-grams for unseen words.

A word that the training texts had is scored by the logarithm of its frequency in each language. Any
other word is scored by its n-grams of the greatest length of which some are known, as the mean of
their log frequencies; if none of that length is known, by the next shorter ones. Sums over all words
of a text decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tracewright.llm.batches import give_back, text_batches
from tracewright.plans.storage import store

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 2000  # bound on the sample of labelled rows, in expectation and per language
MAX_LANGUAGES = 10_000
ENTRIES = 40_000  # bound on the words, and on the n-grams of each length, kept per language
LONGEST = 5  # characters of the longest n-gram
SMOOTHING = 0.1
SURE_WORDS = 10.0  # so many words count as independent evidence at most, for the score
_WORD = re.compile(r"[^\W\d_]+")
_NEW_WORDS = 50_000  # unseen words whose scores a Python worker remembers
_FLUSH = 150_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with a space on both sides; single characters without the spaces."""
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language: part 0 is of words, part n of n-grams of n characters.

    A part is an index of its words or n-grams and a row of `logs` for each.
    """

    languages: list[str]
    index: list[dict[str, int]]
    logs: list[np.ndarray]

    def __post_init__(self) -> None:
        self._new: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.languages, self.index, self.logs

    def __setstate__(self, state):
        self.languages, self.index, self.logs = state
        self._new = {}

    def unseen(self, word: str) -> np.ndarray:
        """The scores of a word by its n-grams: of the greatest length of which some are known."""
        found = self._new.get(word)
        if found is None:
            if len(self._new) >= _NEW_WORDS:
                self._new.clear()
            found = np.zeros(len(self.languages))
            for n in range(LONGEST, 0, -1):
                rows = [r for g in grams_of(word, n) if (r := self.index[n].get(g)) is not None]
                if rows:
                    found = self.logs[n][rows].mean(axis=0)
                    break
            self._new[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of belief; ties go to the first name."""
        words = Counter(words_of(text)) if text else None
        if not self.languages or not words or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        counts = np.fromiter(words.values(), np.float64, len(words))
        rows = np.fromiter(map(self.index[0].get, words, repeat(-1)), np.int64, len(words))
        known = rows >= 0
        total = counts[known] @ self.logs[0][rows[known]]
        if not known.all():
            for word, times, seen in zip(words, counts, known, strict=True):
                if not seen:
                    total = total + times * self.unseen(word)
        belief = np.exp((total - total.max()) * min(1.0, SURE_WORDS / counts.sum()))
        best = int(total.argmax())
        return self.languages[best], float(belief[best] / belief.sum())


def sample_labelled(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """About `docs_per_language` rows of each language, by a hash of the row, all of a smaller one.

    Rows without language or text are left out.
    """
    labelled = docs.where("text is not null and lang is not null").select(
        F.col("text").cast("string"), F.col("lang").cast("string"),
        (F.pmod(F.xxhash64(*docs.columns, F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)).alias("_draw"))
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rates = docs.sparkSession.createDataFrame(pa.table({
        "lang": pa.array([r["lang"] for r in counts], pa.string()),
        "_rate": pa.array([min(1.0, docs_per_language / r["count"]) for r in counts], pa.float64())}))
    return labelled.join(F.broadcast(rates), "lang").where(F.col("_draw") < F.col("_rate")).select("text", "lang")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    counts: dict[tuple[str, int], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, n), grams in counts.items():
            yield pa.record_batch(
                [pa.array([lang] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array(list(grams), pa.string()),
                 pa.array(list(grams.values()), pa.int64())], ["lang", "n", "gram", "count"])
        counts.clear()

    for batch, texts in text_batches(batches):
        for lang, text in zip(batch.column(1).to_pylist(), texts, strict=True):
            words = Counter(words_of(text))
            counts.setdefault((lang, 0), Counter()).update(words)
            for n in range(1, LONGEST + 1):
                grams = counts.setdefault((lang, n), Counter())
                for word, times in words.items():
                    for gram in grams_of(word, n):
                        grams[gram] += times
        if sum(map(len, counts.values())) > _FLUSH:
            yield from flush()
    yield from flush()


def train(sample: DataFrame, entries: int = ENTRIES) -> Model:
    """Count words and n-grams of the sample and keep the most frequent ones of each language.

    At most `entries` words, and n-grams of each length, of each language reach the driver: the least
    count that keeps the bound is read from the table of counts of counts. A sample without rows
    gives a model without languages.
    """
    counts = store(
        sample.select("text", "lang").mapInArrow(_count_grams, "lang string, n int, gram string, count long")
        .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "grams")
    totals, least = {}, {}
    tiers: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for row in counts.groupBy("lang", "n", "count").agg(F.count("*").alias("grams")).toLocalIterator():
        tiers.setdefault((row["lang"], row["n"]), []).append((row["count"], row["grams"]))
    for key, found in tiers.items():
        kept = 0
        totals[key] = sum(c * g for c, g in found)
        least[key] = max(c for c, _ in found) + 1
        for count, grams in sorted(found, reverse=True):
            kept += grams
            if kept > entries:
                break
            least[key] = count
    languages = sorted({lang for lang, _ in tiers})
    if not languages:
        return Model([], [], [])
    floor = sample.sparkSession.createDataFrame(pa.table({
        "lang": pa.array([a for a, _ in least], pa.string()), "n": pa.array([n for _, n in least], pa.int32()),
        "_least": pa.array(least.values(), pa.int64())}))
    kept = counts.join(F.broadcast(floor), ["lang", "n"]).where(F.col("count") >= F.col("_least")).drop("_least")
    place = {lang: i for i, lang in enumerate(languages)}
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    cells: list[list[tuple[int, int, int]]] = [[] for _ in range(LONGEST + 1)]
    for row in kept.toLocalIterator():
        part = index[row["n"]]
        cells[row["n"]].append((part.setdefault(row["gram"], len(part)), place[row["lang"]], row["count"]))
    logs = []
    for n, found in enumerate(cells):
        counted = np.zeros((len(index[n]), len(languages)))
        if found:
            at, lang, count = np.array(found).T
            counted[at, lang] = count
        sizes = np.array([totals.get((lang, n), 0) for lang in languages], np.float64)
        logs.append((np.log(counted + SMOOTHING) - np.log(sizes + SMOOTHING * (len(counted) + 1))).astype(np.float32))
    return Model(languages, index, logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add `lang_pred` and `score` to the documents; every other column stays.

    `und` and 0 for a text that is null or has no letter. The model is broadcast; its size is bounded
    by the entries kept in training. Tables without rows and repeated rows are as any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = shared.value
        for batch, texts in text_batches(batches):
            found = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(score, schema)


def remainder(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text modulo 3; 0 for a missing id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))

