"""Passages of benchmark items in documents, by an FM-index per shard of documents.

A shard is a piece of a partition with a bounded amount of text. Its words are numbered by the
benchmark's vocabulary. Only stretches whose neighbouring words are neighbours in some item can hold a
window, so the index is built over these. Windows are searched backwards in it, all at once; their
places are located and merged into spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import give_back, text_batches
from tracewright.llm.fm_index import FMIndex
from tracewright.plans.storage import store

WINDOW = 10
BLOCK_BYTES = 8 << 20  # text of benchmark items that are searched, and broadcast, at once
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass
class Windows:
    """Distinct windows of a block of items as rows of word numbers, aligned to the right."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]  # of each window
    pairs: np.ndarray  # codes of neighbouring words, in order
    singles: np.ndarray  # windows of one word

    @property
    def size(self) -> int:
        return len(self.vocabulary) + 1


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Windows:
    """All windows of `window` words of the items; an item of fewer words, but not none, is one."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            owners = found.setdefault(tuple(ids[at:at + window]), set())
            if item is not None:
                owners.add(str(item))
    size = len(vocabulary) + 1
    patterns = np.zeros((len(found), window), np.int64)
    for row, ids in enumerate(found):
        patterns[row, window - len(ids):] = ids
    pairs = {a * size + b for ids in found for a, b in zip(ids, ids[1:], strict=False)}
    return Windows(vocabulary, patterns, np.array([len(k) for k in found], np.int64), [sorted(v) for v in found.values()],
                   np.array(sorted(pairs), np.int64), np.array([k[0] for k in found if len(k) == 1], np.int64))


def candidates(ids: np.ndarray, windows: Windows) -> np.ndarray:
    """Places that a window may cover: beside a neighbour as in some item, or a window of one word."""
    keep = np.isin(ids, windows.singles)
    if len(ids) > 1 and len(windows.pairs):
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes = ids[at] * windows.size + ids[at + 1]
        near = np.minimum(np.searchsorted(windows.pairs, codes), len(windows.pairs) - 1)
        joined = np.zeros(len(ids) + 1, bool)
        joined[at[windows.pairs[near] == codes] + 1] = True  # place i is joined to i - 1
        starts = ~joined[:-1]
        run = np.cumsum(starts) - 1
        long_enough = np.bincount(run) >= max(2, int(windows.lengths.min()))
        keep |= long_enough[run]
    return keep


def search(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in numbered words (0 separates documents): number of the window and place."""
    places = np.flatnonzero(candidates(ids, windows))
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # stretches one behind the other, a separator after each
    after = np.cumsum(np.r_[0, np.diff(places) > 1])
    text = np.zeros(len(places) + int(after[-1]) + 1, np.int64)
    origin = np.zeros(len(text), np.int64)
    text[np.arange(len(places)) + after] = ids[places]
    origin[np.arange(len(places)) + after] = places
    index = FMIndex(text, windows.size)
    low, high = index.search(windows.patterns, windows.lengths)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
    return which, origin[index.locate(rows)]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data.translate(_WORD_BYTES))]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


_HITS = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _shard(texts: list[str | None], windows: Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: number of words, merged spans, items."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    get = windows.vocabulary.get
    for start, words in zip(starts, lists, strict=True):
        ids[start:start + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    del lists
    out = [(int(n), [], []) for n in sizes]
    if not len(windows.items):
        return out
    which, at = search(ids, windows)
    if len(which):
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + windows.lengths[which], -1)
        edge = np.diff(np.r_[0, np.cumsum(change)[:-1] > 0, 0])
        doc = np.searchsorted(starts, at, "right") - 1
        for start, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            d = int(np.searchsorted(starts, start, "right")) - 1
            out[d][1].append((int(start - starts[d]), int(end - starts[d])))
        for d, w in np.unique(np.stack((doc, which)), axis=1).T:
            out[d][2].extend(windows.items[w])
    return [(n, spans, sorted(set(items))) for n, spans, items in out]


def _merge(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*spans, *more]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, spans (word places from, to) and item_ids to every row of `docs`; other columns stay.

    `benchmark` has item_id and text. Its items are searched in blocks of about `block_bytes`, each
    against all documents, and what the blocks find is merged. Null and empty texts have no words;
    an item without id hits but is not named; repeated rows are searched one by one. Columns of the
    documents with the names of the results are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    names = [f.split()[0] for f in ("n_words", "spans", "item_ids")]
    out = docs.select(*[c for c in docs.columns if c not in names])
    kept = out.columns
    for number in range(blocks):
        found = items.where(block == number).toArrow().to_pydict()
        shared = spark.sparkContext.broadcast(
            windows_of(list(zip(found["item_id"], found["text"], strict=True)), window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=number == 0) -> Iterator[pa.RecordBatch]:
            give_back()
            windows = shared.value
            for batch, texts in text_batches(batches):
                results = _shard(texts, windows)
                if not first:
                    before = batch.select(names[1:]).to_pylist()
                    results = [
                        (n, _merge(spans, [(s["start"], s["end"]) for s in b["spans"]]), sorted({*ids, *b["item_ids"]}))
                        for (n, spans, ids), b in zip(results, before, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(kept).columns, pa.array([r[0] for r in results], pa.int64()),
                     pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in results], pa.list_(_SPAN)),
                     pa.array([r[2] for r in results], pa.list_(pa.string()))], names=[*kept, *names])

        base = out.select(*kept)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
        out = out.mapInArrow(run, f"{schema}, {_HITS}")
        if blocks > 1:
            out = store(out, "decontaminated")
    return out


def remove(found: DataFrame) -> DataFrame:
    """Take the spans out of the texts of what `find` gives; texts without one stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            cut = [cut_words(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array(cut, pa.string()) if name == "text" else column
                       for name, column in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(run, found.schema)
