"""Fuzzy deduplication of lines over all documents.

Lines are compared in lower case with single spaces. Their character shingles are hashed once and
dealt into BINS bins by the hash (MinHash of one permutation); the least hash of each bin is the
signature, an empty bin borrows from the next. BANDS bands of ROWS values are the keys under which
candidates meet; two lines of similarity 0.8 share one with probability 0.9996. Candidates are verified
on their full shingle sets, linked lines make components, and one line of each component stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import give_back, text_batches
from tracewright.llm.linking import SKETCH, group_members, may_be_similar, share_keys
from tracewright.llm.minhash import mix, parity
from tracewright.plans.skew import BROADCAST_ROWS
from tracewright.plans.storage import store

SHINGLE_CHARS = 7
BANDS, ROWS = 20, 5
BINS = BANDS * ROWS
BLOCK_CHARS = 1 << 18  # hashed at a time
MIN_CHARS = 32  # shorter lines are never removed
PERCENT = 80
MOST_BITS = 1 << 27  # of a set of bits that stands for items
_STEPS = np.random.default_rng(7).integers(0, 1 << 63, SHINGLE_CHARS, np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(np.iinfo(np.uint64).max)


def plain(line: str) -> str:
    return " ".join(line.lower().split())


def _blocks(lines: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The lines, long ones in overlapping parts, in blocks of bounded size: numbers and parts."""
    owners, parts, size = [], [], 0
    for number, line in enumerate(lines):
        for at in range(0, len(line) - SHINGLE_CHARS + 1, BLOCK_CHARS):
            part = line[at:at + BLOCK_CHARS + SHINGLE_CHARS - 1]
            if size + len(part) > BLOCK_CHARS and parts:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(number)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def _hashed(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of all shingles, block by block: numbers of the lines, which rise, and hashes."""
    for owners, parts in _blocks(lines):
        sizes = np.array([len(x) for x in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sums = np.zeros(len(codes) - SHINGLE_CHARS + 1, np.uint64)
        for i, step in enumerate(_STEPS):
            sums += codes[i:len(codes) - SHINGLE_CHARS + 1 + i] * step
        part = np.repeat(np.arange(len(parts)), sizes)[: len(sums)]
        # a shingle does not reach into the next part
        inside = np.arange(len(sums)) + SHINGLE_CHARS <= np.cumsum(sizes)[part]
        yield np.array(owners)[part[inside]], mix(sums[inside])


def signatures(lines: list[str]) -> np.ndarray:
    """The least hash of each bin for lines of at least SHINGLE_CHARS characters; one row per line."""
    lowest = np.full(len(lines) * BINS, _NONE, np.uint64)
    for owner, sums in _hashed(lines):
        # the upper half of a hash picks its bin
        bin_of = ((sums >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(lowest, owner * BINS + bin_of, sums)
    lowest = lowest.reshape(-1, BINS)
    left = np.flatnonzero((lowest == _NONE).any(axis=1))
    for shift in range(1, BINS):
        if not len(left):
            break
        rows = lowest[left]
        borrowed = np.roll(rows, -1, axis=1)
        fill = (rows == _NONE) & (borrowed != _NONE)
        rows[fill] = mix(borrowed[fill] + np.uint64(shift))
        lowest[left] = rows
        left = left[(rows == _NONE).any(axis=1)]
    return lowest


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per line the size of its shingle set and the set's parity."""
    sizes, parities = np.zeros(len(lines), np.int64), np.zeros((len(lines), SKETCH), np.int64)
    short = []
    for number, line in enumerate(lines):
        if len(line) < BLOCK_CHARS:
            short.append(number)
        else:  # the line is in several blocks
            found = np.unique(np.concatenate([sums for _, sums in _hashed([line])]))
            sizes[number], parities[number] = len(found), parity(found)
    for owner, sums in _hashed([lines[i] for i in short]):
        first, owner = owner[0], owner - owner[0]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(sums)], strict=True):
            sums[at:to].sort()
        fresh = np.r_[True, sums[1:] != sums[:-1]]
        fresh[starts] = True
        owner, sums = owner[fresh], sums[fresh]
        numbers = np.array(short)[first:first + owner[-1] + 1]
        sizes[numbers] = np.bincount(owner)
        bits = np.bincount(owner * (64 * SKETCH) + (sums % np.uint64(64 * SKETCH)).astype(np.int64), minlength=len(numbers) * 64 * SKETCH)
        parities[numbers] = np.packbits((bits & 1).astype(np.uint8)).view(np.int64).reshape(-1, SKETCH)
    return sizes, parities


def band_keys(lowest: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(lowest), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in range(ROWS):
        keys = mix(keys * np.uint64(31) + lowest[:, column::ROWS])
    return keys.view(np.int64)


def _eligible(text: str | None) -> Iterator[tuple[int, str]]:
    """Numbers and compared forms of the lines that may be removed."""
    for number, line in enumerate(text.split("\n") if text else ()):
        if len(line) >= MIN_CHARS and len(compared := plain(line)) >= MIN_CHARS:
            yield number, compared


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per eligible line; its keys if the piece of the batch did not have the same line before."""
    give_back()
    for batch, texts in text_batches(batches):
        owner, numbers, digests, first, fresh = [], [], [], {}, []
        for i, text in enumerate(texts):
            for number, line in _eligible(text):
                digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                owner.append(i)
                numbers.append(number)
                digests.append(digest)
                fresh.append(digest not in first)
                first.setdefault(digest, line)
        if not owner:
            continue
        keys = band_keys(signatures(list(first.values())))
        fresh = np.array(fresh)
        offsets = np.r_[0, np.cumsum(np.where(fresh, BANDS, 0))].astype(np.int32)
        high, low = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(high),
             pa.array(low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
            names=["doc_id", "text_hash", "line", "high", "low", "keys"])


def bits_of(items: DataFrame) -> np.ndarray:
    """A bit for each item (rid) in words of 64, at most MOST_BITS: an item whose bit is not set is none of them.

    Spark puts the words together; the driver gets their bounded number alone.
    """
    size, count = 1 << 16, items.count()
    while size < MOST_BITS and size < 16 * count:
        size *= 2
    bit = F.col("rid").bitwiseAND(F.lit(size - 1))
    words = items.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(rid & 63 as int))").alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _among(bits: np.ndarray, rids: np.ndarray) -> np.ndarray:
    at = rids & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _lines_of(wanted):
    """The lines whose bit is set, once for each piece of a batch, with the size and the parity of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for _, texts in text_batches(batches):
            found: dict[int, str] = {}
            for text in texts:
                compared = [line for _, line in _eligible(text)]
                if not compared:
                    continue
                digests = b"".join(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in compared)
                high = np.frombuffer(digests, np.int64)[::2]
                for i in np.flatnonzero(_among(wanted.value, high)).tolist():
                    found[int(high[i])] = compared[i]
            sizes, parities = sketches(list(found.values()))
            yield pa.record_batch(
                [pa.array(list(found), pa.int64()), pa.array(sizes, pa.int64()), pa.array(list(parities), pa.list_(pa.int64())),
                 pa.array(list(found.values()), pa.string())], ["rid", "n", "sketch", "text"])

    return run


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE_CHARS] for i in range(len(line) - SHINGLE_CHARS + 1)}


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, max_bytes=1 << 18):
        sets = [[xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) for s in shingles(t)] for t in texts]
        rid = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.record_batch([pa.array(rid), pa.array(np.concatenate([np.array(x, np.uint64) for x in sets]).view(np.int64))],
                              ["rid", "token"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, leading = None, set()
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            if row["a"] != last:
                last, leading = row["a"], shingles(row["text_a"])
            own = shingles(row["text_b"])
            both = len(leading & own)
            if 100 * both >= PERCENT * (len(leading) + len(own) - both):
                a.append(row["a"])
                b.append(row["b"])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, removed): numbers from 0 of the lines of a document that repeat another one.

    Of each component the line with the smallest (doc_id, hash of the text, number) stays, a missing
    doc_id before all others; lines shorter than MIN_CHARS are in no component. Repeated rows of
    documents are treated alike. Documents that lose no line are not returned.
    """
    rows = _rows(docs)
    lines = store(rows.mapInArrow(
        _sign, "doc_id long, text_hash long, line int, high long, low long, keys array<long>"), "lines")
    keys = lines.select(F.col("high").alias("rid"), F.explode("keys").alias("key")).select("key", "rid")

    def texts_of(items: DataFrame) -> DataFrame:
        wanted = docs.sparkSession.sparkContext.broadcast(bits_of(items))
        found = rows.select("text").mapInArrow(_lines_of(wanted), "rid long, n long, sketch array<long>, text string")
        one = found.join(items, "rid", "left_semi").groupBy("rid").agg(F.first(F.struct("n", "sketch", "text")).alias("one"))
        return store(one.select("rid", "one.*"), "texts")

    # all that is compared later shares a key, so the texts are read once
    members = share_keys(keys)
    texts = texts_of(store(members.select("rid").distinct(), "wanted"))
    known = texts.select("rid", "n", "sketch")

    def verify(pairs: DataFrame) -> DataFrame:
        sized = store(pairs.join(known.toDF("a", "n", "sketch"), "a").join(known.toDF("b", "_on", "_osketch"), "b").where(
            may_be_similar(PERCENT)).select("a", "b"), "sized")
        full = sized.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").join(
            texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")

    def sets(items: DataFrame) -> DataFrame:
        return texts.select("rid", "text").join(items, "rid", "left_semi").mapInArrow(_tokens, "rid long, token long")

    roots = group_members(members, verify, sets, PERCENT, known)
    place = F.struct("doc_id", "text_hash", "line")
    classes = store(lines.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-classes")
    # two lines with the same first half of the hash, which stands for a line above, are left alone
    single = classes.groupBy("high").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("_c")).where("_c = 1")
    grouped = single.join(roots.select(F.col("node").alias("high"), "root"), "high", "left").withColumn(
        "root", F.coalesce("root", "high")).drop("_c")
    linked = grouped.where("n > 1 or root != high").select("root").distinct()
    multiple = grouped.join(linked, "root", "left_semi")
    kept = multiple.groupBy("root").agg(F.min("first").alias("kept"))
    decided = store(multiple.select("high", "root").join(kept, "root").select("high", "kept"), "line-groups")
    lookup = F.broadcast(decided) if decided.count() <= BROADCAST_ROWS else decided
    return lines.select("doc_id", "text_hash", "line", "high").join(lookup, "high").where(
        ~place.eqNullSafe(F.col("kept"))).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines taken out of `text`, and `removed`, the numbers of these lines.

    All other columns and rows stay, `removed` is empty where nothing went; null and empty texts stay
    as they are.
    """
    removed = store(repeated_lines(docs), "removed-lines").withColumnRenamed("doc_id", "_doc")
    lookup = F.broadcast(removed) if removed.count() <= BROADCAST_ROWS else removed
    names = [c for c in docs.columns if c != "removed"]
    keyed = docs.select(*names, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    joined = keyed.join(lookup, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("text_hash")), "left")
    out = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.size("removed") > 0, kept).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in names], out.alias("removed"))
