"""Quality of a text: counts of words, symbols and repetition, and bands of compression ratios.

The ratio of a text's bytes to its zstandard bytes is high for repetitive text and near one for
noise. Whole texts are held against limits that depend on their length, because short texts compress
less; chunks of fixed size against one pair of limits, so that a bad stretch inside a long text shows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import compress

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import text_batches

#: From so many bytes on, the least and the greatest ratio of a whole text.
BANDS = ((0, 0.0, 3.0), (100, 0.75, 3.5), (300, 1.15, 3.5), (1000, 1.35, 4.0), (3000, 1.45, 4.5), (10_000, 1.5, 5.5),
         (50_000, 1.5, 7.0))
CHUNK_BYTES = 2048
CHUNK_BAND = (1.3, 4.5)
BAD_CHUNKS = 0.2  # greatest share of chunks outside their band
LEVEL = 3
WINDOW = 5
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """The data in chunks of `size`; a rest shorter than half of that belongs to the last one."""
    cuts = list(range(0, max(len(data) - size // 2, 1), size))
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def repeated_words(words: Sequence, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that the text has more than once."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered = reach = 0
    for at in compress(range(len(windows)), (times[w] > 1 for w in windows)):
        covered += at + window - max(at, reach)
        reach = at + window
    return covered


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    """Counts, ratio, chunks outside their band, number of chunks, whether base and bands hold."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    word_chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            dup_lines += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    ratio = len(data) / len(compressor.compress(data))
    _, low, high = BANDS[bisect_right(BANDS, (len(data), float("inf"), 0.0)) - 1]
    parts = chunks(data) if len(data) >= CHUNK_BYTES else []
    bad = sum(not CHUNK_BAND[0] <= len(c) / len(compressor.compress(c)) <= CHUNK_BAND[1] for c in parts)
    inside = low <= ratio <= high and bad <= BAD_CHUNKS * len(parts)
    return (len(words), word_chars, symbols, dup_lines, repeats, ratio, bad, len(parts), failed, not failed and inside)


_FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
           "n_bad_chunks long, n_chunks long, base_failed boolean, kept boolean")
_TYPES = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2


def judge(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, counts, compression figures, `base_failed` and the verdict `kept`.

    A null text counts as an empty one: no words, so base_failed. Repeated rows are judged one by one;
    other columns are ignored; no rows give none.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch, texts in text_batches(batches):
            columns = zip(*(measure(t, compressor) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, {_FIELDS}")
