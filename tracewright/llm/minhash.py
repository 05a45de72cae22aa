"""Near-duplicate documents by MinHash with tensored tables and exact verification.

Instead of independent functions for every table, two collections of MEMBERS tuples of HALF minhash
values are computed, and every pair of one tuple from each makes the key of a table: MEMBERS squared
tables for 2 * MEMBERS * HALF minhash values. Two sets of similarity 0.8 share a key with probability
0.9993, more similar ones more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import REMEMBERED, give_back, text_batches
from tracewright.llm.linking import SKETCH, group_similar
from tracewright.plans.skew import BROADCAST_ROWS
from tracewright.plans.storage import store

MEMBERS, HALF = 11, 3
SHINGLE_WORDS = 5
THRESHOLD = 80  # percent
_SLICE = 1 << 15  # shingles hashed at a time
_WORDS_KNOWN = 250_000
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 63, 2 * MEMBERS * HALF, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[bytes, int] = {}
REMEMBERED.append(_known)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those of frequent words are remembered by the Python worker."""
    if new := set(words).difference(_known):
        if len(_known) + len(new) > _WORDS_KNOWN:
            _known.clear()
            new = set(words)
        _known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; of all words, if there are fewer.

    Words stand between white space (space, tab, line ends and the like), with A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    size = min(size, len(words))
    sums = np.zeros(len(words) - size + 1, np.uint64) + np.uint64(size)
    for i in range(size):
        sums = mix(sums + hashes[i:len(words) - size + 1 + i] * _STEPS[i % 64])
    return np.unique(sums)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One number per tuple of the two collections."""
    lowest = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _SLICE):
        np.minimum(lowest, (shingles[at:at + _SLICE, None] * _FACTORS).min(axis=0), out=lowest)
    tuples = np.zeros(2 * MEMBERS, np.uint64)
    for column in lowest.reshape(2 * MEMBERS, HALF).T:
        tuples = mix(tuples * np.uint64(31) + column)
    return mix(tuples + np.arange(2 * MEMBERS, dtype=np.uint64))


def parity(shingles: np.ndarray) -> np.ndarray:
    """SKETCH longs; two sets differ in at least as many shingles as these do in bits."""
    odd = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = THRESHOLD) -> bool:
    """100 * intersection >= percent * union, of sorted distinct numbers."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(_known)
        for batch, texts in text_batches(batches):
            counts, digests, tuples, sketches = [], [], [], []
            for text in texts:
                shingles = shingle_set(text, size)
                counts.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                tuples.append(signature(shingles).view(np.int64) if len(shingles) else None)
                sketches.append(parity(shingles))
            high, low = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
            keep = batch.select(["rid", "doc_id", "text_hash"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(counts, pa.int64()), pa.array(high), pa.array(low),
                 pa.array(tuples, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "text_hash", "n_shingles", "set_high", "set_low", "tuples", "sketch"])

    return run


def _verify_sets(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leading = None, None
        for batch, texts in text_batches(batches, "text_b"):
            first, second = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            leaders = batch.column(batch.schema.get_field_index("text_a"))
            for i, (a, text) in enumerate(zip(first, texts, strict=True)):
                if a != last:
                    last, leading = a, shingle_set(leaders[i].as_py(), size)
                linked.append(similar(leading, shingle_set(text, size), percent))
            kept = [i for i, x in enumerate(linked) if x]
            yield pa.record_batch([pa.array([first[i] for i in kept], pa.int64()),
                                   pa.array([second[i] for i in kept], pa.int64())], ["a", "b"])

    return run


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            sets = [shingle_set(t, size) for t in texts]
            rid = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.record_batch([pa.array(rid), pa.array(np.concatenate(sets).view(np.int64))], ["rid", "token"])

    return run


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD
) -> DataFrame:
    """Per row of `docs`: doc_id, text_hash, n_shingles, component and component_id, the smallest doc_id reachable by links.

    Links join rows whose sets have a similarity of `percent` or more; candidates come from shared
    table keys and are confirmed on full sets of 64-bit shingle hashes. Rows with equal sets are one
    class from the start, so copies are never paired. A row without words or text has no links and is
    its own component, also when its doc_id repeats. A null doc_id counts only if there is no other in
    the component. Repeated rows are in one component. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn(
        "text_hash", F.xxhash64("text"))
    signed = store(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _sign(shingle_words),
        "rid long, doc_id long, text_hash long, n_shingles long, set_high long, set_low long, tuples array<long>, sketch array<long>"),
        "signatures")
    filled = signed.where("n_shingles > 0")
    classes = store(filled.groupBy("set_high", "set_low").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("min_doc"), F.count("*").alias("copies")), "classes")
    # copies have no part in the search: only the rows that stand for a class
    named = store(filled.join(classes.select("rid"), "rid", "left_semi"), "named")
    keyed = named.select("rid", F.slice("tuples", 1, MEMBERS).alias("left"),
                         F.slice("tuples", MEMBERS + 1, MEMBERS).alias("right"))
    keyed = keyed.select("rid", "right", F.explode("left").alias("one"))
    keys = keyed.select("rid", "one", F.explode("right").alias("two")).select(F.xxhash64("one", "two").alias("key"), "rid")

    def texts_of(items: DataFrame) -> DataFrame:
        places = store(named.join(items, "rid", "left_semi").select("rid", "doc_id", "text_hash"), "wanted")
        lookup = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
        found = rows.alias("r").join(
            lookup.alias("p"), F.expr("r.doc_id <=> p.doc_id and r.text_hash = p.text_hash")).select("p.rid", "r.text")
        return store(found.groupBy("rid").agg(F.first("text").alias("text")), "texts")

    def sets(items: DataFrame) -> DataFrame:
        return texts_of(items).mapInArrow(_tokens(shingle_words), "rid long, token long")

    def verify(pairs: DataFrame) -> DataFrame:
        known = named.select("rid", "n_shingles", "sketch")
        # no more tokens can differ than a similarity of `percent` allows
        differ = " + ".join(f"bit_count(_sa[{i}] ^ _sb[{i}])" for i in range(SKETCH))
        sized = pairs.join(known.toDF("a", "_na", "_sa"), "a").join(known.toDF("b", "_nb", "_sb"), "b").where(
            f"100 * least(_na, _nb) >= {percent} * greatest(_na, _nb) and "
            f"{100 + percent} * ({differ}) <= {100 - percent} * (_na + _nb)").select("a", "b")
        sized = store(sized, "sized")
        texts = texts_of(sized.select("a").union(sized.select("b")).distinct().toDF("rid"))
        full = sized.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(
            _verify_sets(shingle_words, percent), "a long, b long")

    roots = group_similar(keys, verify, sets, percent)
    joined = classes.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid"))
    smallest = joined.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    grouped = joined.select("set_high", "set_low", "root").join(smallest, "root").withColumnRenamed("root", "component")
    grouped = store(grouped, "components")
    linked = filled.select("doc_id", "text_hash", "n_shingles", "set_high", "set_low").join(
        grouped, ["set_high", "set_low"]).select("doc_id", "text_hash", "n_shingles", "component", "component_id")
    alone = signed.where("n_shingles = 0").select(
        "doc_id", "text_hash", "n_shingles", F.col("rid").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id stays.

    Ties go by the hash of the text, and of equal rows one stays. Rows without words all stay. Columns
    stay as they are.
    """
    found = store(near_duplicates(docs, shingle_words, percent), "near-duplicates")
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    chosen = found.where((F.col("n_shingles") > 0) & mine).groupBy("component").agg(F.min("text_hash").alias("_hash"))
    # how many rows of a component are the chosen one
    winners = found.join(chosen, "component").where((F.col("text_hash") == F.col("_hash")) & mine).groupBy(
        F.col("doc_id").alias("_doc"), "_hash").agg(F.count("*").alias("_times"))
    empty = found.where("n_shingles = 0").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    stay = store(winners.unionByName(empty.withColumn("_times", F.lit(1).cast("long"))), "kept")
    lookup = F.broadcast(stay) if stay.count() <= BROADCAST_ROWS else stay
    keyed = docs.select(*docs.columns, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    joined = keyed.join(lookup, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")))
    repeated = joined.where("_times > 1").dropDuplicates(["_id", "_text"])
    return joined.where("_times = 1").unionByName(repeated).select(*docs.columns)
