"""Passages that occur more than once, by a sparse suffix array over all documents.

Only suffixes at content-selected places are kept: the starts of the GRAM-word grams whose hash is the
least of a window (minimisers). A passage of MIN_WORDS words has such a place, the same one in every
occurrence. The suffixes are sorted by the hash of their gram and then by the hash of the words around
it, and neighbours are compared. Neighbours that agree in both share everything around the place. Where
neighbours agree in the gram alone, the match is extended to the left and to the right: the passages
of MIN_WORDS words that hold the gram are sorted and compared in the same way, one suffix for each
kind of surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import text_batches
from tracewright.llm.minhash import mix, word_hashes
from tracewright.plans.skew import BROADCAST_ROWS
from tracewright.plans.storage import store

MIN_WORDS = 50
GRAM = 25
AROUND = MIN_WORDS - GRAM  # words to each side of a gram that a passage may reach
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROW = "gram long, around long, doc_id long, text_hash long, place int, n_words int"
_COLUMNS = ["gram", "around", "doc_id", "text_hash", "place", "n_words"]


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Hashes:
    """Hashes of any stretch of a document's words, from sums of powers."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        powers = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _BASE), out=powers[1:])
        self._back = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _INVERSE), out=self._back[1:])
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes(words) * powers[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))


def selected(grams: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some window of AROUND + 1 grams; the first of equal ones."""
    if len(grams) <= AROUND:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, AROUND + 1)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches):
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for i, text in enumerate(texts):
            words = words_of(text)
            n = len(words)
            if n < MIN_WORDS:
                continue
            hashes, starts = Hashes(words), np.arange(n - GRAM + 1)
            grams = hashes.of(starts, starts + GRAM)
            at = selected(grams)
            left, right = np.minimum(at, AROUND), np.minimum(n - GRAM - at, AROUND)
            # the surroundings also tell how far they reach
            around = mix(hashes.of(at - left, at + GRAM + right) + (left * 64 + right).astype(np.uint64))
            for column, values in zip(out, (grams[at], around, np.full(len(at), i), at, np.full(len(at), n)), strict=True):
                column.append(values)
        if not out[0]:
            continue
        gram, around, owner, place, n = (np.concatenate(c) for c in out)
        row = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(row),
             batch.column(1).take(row), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], names=_COLUMNS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows that agree with a neighbour, and whether in both hashes or in the first alone.

    The first and the last row of the partition come once more, with `edge` 0 and 1.
    """
    part = TaskContext.get().partitionId()

    def out(table: pa.Table, same, differs, edge: int | None) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        table = table.append_column("same", pa.array(same, pa.bool_())).append_column("differs", pa.array(differs, pa.bool_()))
        table = table.append_column("part", pa.array([part] * n, pa.int32())).append_column("edge", pa.array([edge] * n, pa.int32()))
        yield from table.combine_chunks().to_batches()

    held, before = None, (False, False)  # the last row, and how it agrees with the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is None:
            yield from out(table.slice(0, 1), [False], [False], 0)
        else:
            table = pa.concat_tables([held, table])
        gram, around = (table.column(i).to_numpy() for i in (0, 1))
        alike = gram[1:] == gram[:-1]
        equal = alike & (around[1:] == around[:-1])
        unlike = alike & ~equal
        same, differs = np.r_[before[0], equal], np.r_[before[1], unlike]
        following = (bool(same[-1]), bool(differs[-1]))
        same[:-1] |= equal
        differs[:-1] |= unlike
        chosen = (same | differs)[:-1]
        keep = np.flatnonzero(chosen)
        yield from out(table.take(pa.array(keep)), same[keep], differs[keep], None)
        held, before = table.slice(table.num_rows - 1), following
    if held is not None:
        if any(before):
            yield from out(held, [before[0]], [before[1]], None)
        yield from out(held, [False], [False], 1)


def compare_neighbours(rows: DataFrame) -> DataFrame:
    """Sort rows by (gram, around) over all partitions; those that agree with a neighbour in `gram`.

    `same`: also in `around`; `differs`: with one in `gram` alone. Rows of a frequent gram are spread
    over partitions by document and place; the rows at the partitions' borders, two for each, are
    compared in a second step. A row may be returned twice.
    """
    order = ["gram", "around", "doc_id", "text_hash", "place"]
    found = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _compare, f"{_ROW}, same boolean, differs boolean, part int, edge int"), "neighbours")
    line = Window.orderBy("part", "edge")
    borders = found.where("edge is not null")
    for name, step in (("_back", F.lag), ("_ahead", F.lead)):
        borders = borders.withColumn(name, step(F.struct("gram", "around", "edge")).over(line))
    # the last row of a partition and the first of the next one
    back = (F.col("edge") == 0) & (F.col("_back.gram") == F.col("gram"))
    ahead = (F.col("edge") == 1) & (F.col("_ahead.gram") == F.col("gram"))
    same = (back & (F.col("_back.around") == F.col("around"))) | (ahead & (F.col("_ahead.around") == F.col("around")))
    met = borders.where(back | ahead).withColumn("same", F.coalesce(same, F.lit(False))).withColumn("differs", ~F.col("same"))
    columns = [*_COLUMNS, "same", "differs"]
    return found.where("edge is null").select(*columns).unionByName(met.select(*columns))


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All passages of MIN_WORDS words around the given places."""
    for batch, texts in text_batches(batches):
        places = batch.column(batch.schema.get_field_index("places")).to_pylist()
        for i, text in enumerate(texts):
            words = words_of(text)
            starts = np.unique((np.array(places[i], np.int64)[:, None] - np.arange(AROUND + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + MIN_WORDS <= len(words))]
            if len(starts):
                row, n = pa.array(np.full(len(starts), i)), len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(Hashes(words).of(starts, starts + MIN_WORDS).view(np.int64)), pa.array(np.zeros(n, np.int64)),
                     batch.column(0).take(row), batch.column(1).take(row), pa.array(starts.astype(np.int32)),
                     pa.array(np.full(n, len(words), np.int32))], names=_COLUMNS)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, spans): the word places from, to of all passages of MIN_WORDS words or more that repeat.

    A span is a union of stretches of MIN_WORDS words that occur a second time, in another document or
    in the same one; words are hashed to 64 bits. Repeated rows repeat each other. Null, empty and
    shorter texts have none, and rows without a span are not returned. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    suffixes = store(rows.mapInArrow(_suffixes, _ROW), "suffixes")
    found = store(compare_neighbours(suffixes), "repeats")
    whole = found.where("same").select(
        "doc_id", "text_hash", "n_words", F.greatest(F.col("place") - AROUND, F.lit(0)).alias("start"),
        F.least(F.col("place") + GRAM + AROUND, "n_words").alias("end")).where(F.col("end") - F.col("start") >= MIN_WORDS)
    # a document has fewer places than words
    open_ = store(found.where("differs").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("place").alias("places")), "open")
    lookup = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    texts = rows.join(lookup, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    passages = store(texts.select("doc_id", "text_hash", "text", "places").mapInArrow(_extend, _ROW), "extended")
    extended = compare_neighbours(passages).where("same").select(
        "doc_id", "text_hash", "n_words", F.col("place").alias("start"), (F.col("place") + MIN_WORDS).alias("end"))
    spans = whole.unionByName(extended).groupBy("doc_id", "text_hash").agg(
        F.first("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    return spans.select("doc_id", "text_hash", "n_words", _merged("_spans").alias("spans"))


def _merged(spans: str) -> F.Column:
    """Sorted spans with those that overlap or touch made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(
            F.concat(done, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end")))))

    return F.aggregate(spans, empty, add)
