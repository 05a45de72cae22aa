"""Periodic runs of words: stretches of a text that repeat with some period three times or more.

The words of a text are sorted by suffix, and each interval of suffixes that share `depth` words is
tested for branching tandems: a suffix of its smaller side at place i makes a square with period
`depth` if the suffix at i + depth or i - depth lies on the other side. Both sides differ in the next
word, so such a square can not be shifted to the right, and every run ends with one. Shifting it to the
left as far as words agree gives the run. All steps work on whole arrays of a batch of texts; sides and
suffixes are ranges of the sorted order, and no tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import text_batches

MIN_WORDS = 24
MIN_PERIODS = 3
BATCH_BYTES = 2 << 20
FIRST_STEP = 4  # words compared at once at first; twice as many in each further round


def ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges one after another, and which range each is of."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    before = np.cumsum(lengths) - lengths
    return np.arange(len(owner)) - before[owner] + starts[owner], owner


def agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places a and b on, forward (`step` 1) or backward (-1).

    Every pair has to meet a difference before the array ends, as the end mark of a text is one; there is
    nothing before place 0. A block twice as long is compared in each round, so the work is in
    proportion to what agrees.
    """
    agreed = np.zeros(len(a), np.int64)
    left, block = np.arange(len(a)), FIRST_STEP
    while len(left):
        # long blocks are worked off in slices of the pairs: memory stays bounded
        portion = max(1, (1 << 20) // block)
        going = []
        for at in range(0, len(left), portion):
            some = left[at:at + portion]
            shift = step * (agreed[some][:, None] + np.arange(block))
            x, y = a[some][:, None] + shift, b[some][:, None] + shift
            differs = (x < 0) | (words[np.clip(x, 0, len(words) - 1)] != words[np.clip(y, 0, len(words) - 1)])
            first = differs.argmax(axis=1)
            ends = differs[np.arange(len(some)), first]
            agreed[some] += np.where(ends, first, block)
            going.append(some[~ends])
        left = np.concatenate(going)
        block = min(2 * block, 1 << 16)
    return agreed


def suffix_order(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by doubling; texts stay apart, each ends with its only 0."""
    n = len(words)
    key = texts * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, sizes)
    done = 1
    while (open_ := sizes > 1).any():
        slots, group = ranges(head[open_], sizes[open_])
        places = order[slots]
        # groups lie in order already: only the rank of what follows is compared inside them
        key = group * n + rank[places + done]
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[slots] = places
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        head, sizes = slots[new], np.diff(np.r_[new, len(key)])
        rank[places] = np.repeat(head, sizes)
        done *= 2
    return order, rank


def common_prefixes(words: np.ndarray, starts: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order; -1 for the first of a text.

    Where both are preceded by the same word, the number is one less than that of the suffix before in
    the text. Only the others are compared; their sum is in proportion to n log n.
    """
    n = len(words)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = 0
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    same = np.zeros(n, bool)
    same[1:] = (words[:-1] == words[before[1:] - 1]) & ~is_start[1:] & ~is_start[before[1:]]
    firsts = order[starts]  # the suffix that only has the end mark: texts fill the same places in order
    same[firsts] = False
    known = np.zeros(n, np.int64)
    compared = np.flatnonzero(~same)
    rest = compared[~np.isin(compared, firsts)]
    known[rest] = agreement(words, rest, before[rest], 1)
    last = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    shared = known[last] - (np.arange(n) - last)
    shared[firsts] = -1
    return shared[order]


def _nearest(values: np.ndarray, places: np.ndarray, strict: bool, step: int) -> np.ndarray:
    """The nearest place before (`step` -1) or after (1) with a value below, or not above if not `strict`.

    There has to be one. A tree of minima is climbed until a sibling on that side is low enough, then
    descended; all places climb at once.
    """
    levels = [values]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = np.r_[low, np.iinfo(low.dtype).max]
            levels[-1] = low
        levels.append(np.minimum(low[::2], low[1::2]))
    limit = values[places] if not strict else values[places] - 1
    node, left, found = places.copy(), np.arange(len(places)), []
    odd = 1 if step < 0 else 0
    for level, low in enumerate(levels[:-1]):
        here = node[left]
        beside = np.clip(here + step, 0, len(low) - 1)
        hit = (here % 2 == odd) & (low[beside] <= limit[left])
        found.append((level, left[hit], beside[hit]))
        left = left[~hit]
        node[left] //= 2
        if not len(left):
            break
    who, at = np.empty(0, np.int64), np.empty(0, np.int64)
    for level, more, beside in reversed(found):
        who, at = np.r_[who, more], np.r_[at, beside]
        if level:
            low = levels[level - 1]
            near = 2 * at + (1 if step < 0 else 0)
            at = np.where(low[near] <= limit[who], near, 2 * at + (0 if step < 0 else 1))
    out = np.empty(len(places), np.int64)
    out[who] = at
    return out


def squares(words: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and period of every branching tandem."""
    order, rank = suffix_order(words, texts)
    shared = common_prefixes(words, starts, order, rank)
    splits = np.flatnonzero(shared > 0)
    if not len(splits):
        return splits, splits
    closed = np.r_[shared, -1]
    depth = shared[splits]
    low = _nearest(closed, splits, False, -1)
    high = _nearest(closed, splits, True, 1)  # the interval is low .. high - 1, split before splits
    left_smaller = splits - low <= high - splits
    sizes = np.where(left_smaller, splits - low, high - splits)
    first, period = [], []
    # the suffixes of smaller sides, a bounded number at a time
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 1 << 21), "left")
    for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        slots, owner = ranges(np.where(left_smaller, low, splits)[a:b], sizes[a:b])
        owner += a
        other_low = np.where(left_smaller, splits, low)[owner]
        other_high = np.where(left_smaller, high, splits)[owner]
        place, d = order[slots], depth[owner]
        for partner, start in ((place + d, place), (place - d, place - d)):
            at = rank[np.clip(partner, 0, len(words) - 1)]
            hit = (partner >= 0) & (partner < len(words)) & (at >= other_low) & (at < other_high)
            first.append(start[hit])
            period.append(d[hit])
    return np.concatenate(first), np.concatenate(period)


def runs_of(words: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of two periods or more, in order of the end.

    A stretch has a square for each multiple of its period, all with the same end. The smallest period
    of an end is rotated first; its multiples inside the run found need no look.
    """
    first, period = squares(words, texts, starts)
    by = np.lexsort((period, first + 2 * period))
    first, period = first[by], period[by]
    end = first + 2 * period
    found = []
    while len(first):
        lead = np.r_[True, end[1:] != end[:-1]]
        s, p = first[lead], period[lead]
        begin = s - agreement(words, s - 1, s + p - 1, -1)
        found.append((begin, end[lead], p))
        of = np.cumsum(lead) - 1
        rest = ~lead & ~((period % p[of] == 0) & (first >= begin[of]))
        first, period, end = first[rest], period[rest], end[rest]
    if not found:
        return first, end, period
    begin, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(end, kind="stable")
    return begin[by], end[by], period[by]


def _encode(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, their numbers with a 0 at the end of each text, text numbers, starts of texts."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    flat = [w for words in split for w in words]
    numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    counts = np.array([len(w) for w in split], np.int64)
    starts = np.r_[0, np.cumsum(counts + 1)[:-1]]
    words = np.zeros(len(flat) + len(split), np.int64)
    words[ranges(starts, counts)[0]] = numbers
    return flat, words, np.repeat(np.arange(len(split)), counts + 1), starts


def find(texts: list[str | None], min_words: int, min_periods: int) -> list[tuple]:
    """Per text: number of words, runs (start, length, period), the one of most periods, and the collapsed text."""
    flat, words, owner, starts = _encode(texts)
    begin, end, period = runs_of(words, owner, starts)
    kept = end - begin >= np.maximum(min_words, min_periods * period)
    begin, end, period = begin[kept], end[kept], period[kept]
    by = np.lexsort((period, begin))
    begin, end, period = begin[by], end[by], period[by]
    # words covered beyond the first period of some run
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, begin + period, 1)
    np.add.at(covered, end, -1)
    dropped = np.cumsum(covered)[:-1] > 0
    bounds = np.searchsorted(begin, np.r_[starts, len(words)])
    out, at = [], 0
    for i, start in enumerate(starts.tolist()):
        stop = int(starts[i + 1]) if i + 1 < len(starts) else len(words)
        n = stop - start - 1
        some = slice(int(bounds[i]), int(bounds[i + 1]))
        rows = list(zip((begin[some] - start).tolist(), (end[some] - begin[some]).tolist(), period[some].tolist(), strict=True))
        mine = flat[at:at + n]
        if rows:
            gone = dropped[start:stop - 1].tolist()
            mine = [w for w, g in zip(mine, gone, strict=True) if not g]
        best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        out.append((n, rows, best, b" ".join(mine)))
        at += n
    return out


_RUN = "struct<start:long,length:long,period:long>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, `runs`, `best` and the `collapsed` text.

    A run is a stretch of consecutive words with a smallest period, at least `min_words` words and
    `min_periods` periods long, that no neighbouring word extends; `runs` holds start (from 0), length and
    period in order of start, then period. `best` is the one of most periods, ties by start, then
    period. The collapsed text has the words that are in no run beyond its first period, joined by one
    space. A null text has no words, as an empty one: no runs, null `best`, empty `collapsed`. Rows are
    taken one by one, repeated ones alike; other columns are ignored; no rows give none. A text is
    worked on whole, with some 300 bytes a word in memory.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, max_bytes=BATCH_BYTES):
            n, rows, best, text = zip(*find(texts, min_words, min_periods), strict=True)
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in rows]
            top = [dict(zip(("start", "length", "period"), r, strict=True)) if r else None for r in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(named, pa.list_(_RUN_TYPE)), pa.array(top, _RUN_TYPE),
                 pa.array(text, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, f"doc_id long, n_words long, runs array<{_RUN}>, best {_RUN}, collapsed string")
