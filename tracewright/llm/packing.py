"""Packing token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt into shards of bounded size where they are made. Each shard is packed by several
islands, rows of a table that Spark deals out. An island starts from best-fit packings and evolves
whole bins: crossover injects well-filled bins of one parent into the other, drops the bins that
hold the same pieces, and best-fits the displaced ones. Between rounds each island receives the
best packing of its neighbour. Pieces in badly filled bins of all shards are dealt anew and packed
again, until one shard holds them.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import give_back, text_batches
from tracewright.llm.tokens import ENCODERS, encoder
from tracewright.plans.storage import store

CAPACITY = 4096
SHARD_PIECES = 4096
ISLANDS = 2
ROUNDS = 2
CHILDREN = 12  # per island and round
POPULATION = 4
GOOD_FILL = 0.98  # bins below are opened again across shards
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, item int"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of every document, its end id included, dealt into shards.

    Only longer documents are cut; the last piece may be shorter. A document without text, or with an
    empty one, is its end id alone. Repeated rows are pieces of their own, told apart by
    (shard, item). Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(ENCODERS)
        encode = encoder(tokenizer)
        give_back(ENCODERS)  # what reading the tokenizer's file took
        end = np.array([end_id], encode.dtype).tobytes()
        first, made = TaskContext.get().partitionId() << 24, 0
        for batch, texts in text_batches(batches, max_bytes=1 << 20):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                wide = np.frombuffer(ids + end, encode.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(wide), capacity)):
                    part = wide[start:start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part),
                                 first + made // SHARD_PIECES, made % SHARD_PIECES))
                    made += 1
            columns = [list(x) for x in zip(*rows, strict=True)]
            yield pa.record_batch(
                [pa.array(c, pa.int32() if i in (1, 6) else pa.int64()) for i, c in enumerate(columns)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "item"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, _PIECES)


class Bins:
    """Bins that find the fullest one with enough room, by a bit set of the rooms there are."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self._by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self._rooms = 0
        self._next = 0

    def _place(self, b: int, room: int) -> None:
        self.room[b] = room
        self._by_room[room].add(b)
        self._rooms |= 1 << room

    def _lift(self, b: int) -> int:
        room = self.room[b]
        self._by_room[room].remove(b)
        if not self._by_room[room]:
            self._rooms ^= 1 << room
        return room

    def open(self, items: list[int]) -> None:
        self.items[self._next] = items
        self._place(self._next, self.capacity - sum(self.sizes[i] for i in items))
        self._next += 1

    def close(self, b: int) -> list[int]:
        self._lift(b)
        del self.room[b]
        return self.items.pop(b)

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the fullest bin that has room, else into a new one."""
        for i in items:
            size = self.sizes[i]
            fits = self._rooms >> size
            if not fits:
                self.open([i])
                continue
            room = size + (fits & -fits).bit_length() - 1
            b = min(self._by_room[room])
            self._lift(b)
            self.items[b].append(i)
            self._place(b, room - size)

    def packing(self) -> list[list[int]]:
        return list(self.items.values())


def fitness(packing: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are very full or rather empty."""
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def fit(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(sizes, capacity)
    bins.best_fit(order)
    return bins.packing()


def crossover(
    giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, draw: random.Random
) -> list[list[int]]:
    """Inject whole well-filled bins of one packing into another."""
    filled = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    injected = [b for b in filled[: max(1, len(filled) // 2)] if draw.random() < 0.5] or filled[:1]
    taken = {i for b in injected for i in b}
    bins, displaced = Bins(sizes, capacity), []
    for b in taker:
        if taken.isdisjoint(b):
            bins.open(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    for b in injected:
        bins.open(list(b))
    displaced.sort(key=lambda i: (-sizes[i], i))
    bins.best_fit(displaced)
    return bins.packing()


def mutate(packing: list[list[int]], sizes: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """Empty the least filled bins and a few others, and best-fit their pieces."""
    bins = Bins(sizes, capacity)
    ordered = sorted(packing, key=lambda b: sum(sizes[i] for i in b))
    few = max(1, len(ordered) // 50)
    out = [i for b in ordered[:few] for i in b]
    for b in ordered[few:]:
        if draw.random() < 0.02:
            out += b
        else:
            bins.open(list(b))
    out.sort(key=lambda i: (-sizes[i], draw.random()))
    bins.best_fit(out)
    return bins.packing()


def evolve(
    sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]], children: int = CHILDREN,
    population: int = POPULATION,
) -> list[list[int]]:
    """The best packing an island finds, from given packings and best-fit ones; stops at the lower bound."""
    draw, least = random.Random(seed), max(1, math.ceil(sum(sizes) / capacity))
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    pool = [*start, fit(sizes, falling, capacity)] if not start else list(start)
    while len(pool) < population and min(map(len, pool)) > least:
        spread = 1 + 0.3 * len(pool)
        order = sorted(falling, key=lambda i: -sizes[i] * draw.uniform(1, spread))
        pool.append(fit(sizes, order, capacity))

    def rank(p: list[list[int]]) -> tuple[int, float]:
        return fitness(p, sizes, capacity)

    pool.sort(key=rank, reverse=True)
    for _ in range(children):
        if len(pool[0]) <= least or len(pool) < 2:
            break
        giver, taker = draw.sample(range(len(pool)), 2)
        child = crossover(pool[giver], pool[taker], sizes, capacity, draw)
        if draw.random() < 0.5:
            child = mutate(child, sizes, capacity, draw)
        pool = sorted([*pool, child], key=rank, reverse=True)[:population]
    return pool[0]


def _genome(packing: list[list[int]], count: int) -> bytes:
    bin_of = np.zeros(count, "<u4")
    for b, items in enumerate(packing):
        bin_of[items] = b
    return bin_of.tobytes()


def _packing(genome: bytes) -> list[list[int]]:
    bin_of = np.frombuffer(genome, "<u4")
    order = np.argsort(bin_of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)]


def _pack_shards(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """(shard, at, length) -> (shard, at, length, sequence_id, fill, offset); `at` is the key of a piece."""
    # at most about SHARD_PIECES pieces a shard
    shards = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("_all")).select(
        "shard", F.col("_all.at").alias("ats"), F.col("_all.length").alias("sizes"))
    state = shards.select("*", F.array().cast("array<binary>").alias("elites"))
    for turn in range(ROUNDS):

        def island(batches, turn=turn):
            for batch in batches:
                for row in batch.to_pylist():
                    start = [_packing(g) for g in row["elites"]]
                    seed = zlib.crc32(repr((row["shard"], row["island"], turn, level)).encode())
                    best = evolve(row["sizes"], capacity, seed, start)
                    yield pa.record_batch(
                        [pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()),
                         pa.array([-len(best)], pa.int64()),
                         pa.array([fitness(best, row["sizes"], capacity)[1]], pa.float64()),
                         pa.array([_genome(best, len(row["sizes"]))], pa.binary())],
                        ["shard", "island", "bins", "fill", "genome"])

        islands = state.select("shard", "sizes", "elites", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
        # an island keeps its own best packing and receives its neighbour's
        own = F.expr("filter(elites, (e, i) -> i = island or i = (island + 1) % size(elites))")
        grown = islands.select("shard", "island", "sizes", own.alias("elites")).mapInArrow(
            island, "shard long, island int, bins long, fill double, genome binary")
        elites = grown.groupBy("shard").agg(
            F.sort_array(F.collect_list(F.struct("island", "genome"))).alias("_e"),
            F.max_by("genome", F.struct("bins", "fill", -F.col("island"))).alias("best"))
        state = store(shards.join(elites.select("shard", F.col("_e.genome").alias("elites"), "best"), "shard"),
                      "packing")

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, bin_of = np.array(row["sizes"], np.int64), np.frombuffer(row["best"], "<u4").astype(np.int64)
                order = np.argsort(bin_of, kind="stable")
                sums = np.cumsum(sizes[order]) - sizes[order]
                firsts = np.flatnonzero(np.r_[True, np.diff(bin_of[order]) > 0])
                runs = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(order)]))
                offset, fill = np.empty_like(sizes), np.bincount(bin_of, sizes).astype(np.int64)
                offset[order] = sums - sums[firsts][runs]
                ats, sequence = np.array(row["ats"], np.int64), np.empty_like(sizes)
                sequence[order] = ats[order][firsts][runs]  # a sequence is named by its first piece
                yield pa.record_batch(
                    [pa.array(np.full(len(sizes), row["shard"])), pa.array(ats), pa.array(sizes),
                     pa.array(sequence), pa.array(fill[bin_of]), pa.array(offset)],
                    ["shard", "at", "length", "sequence_id", "fill", "offset"])

    return state.select("shard", "ats", "sizes", "best").mapInArrow(
        place, "shard long, at long, length long, sequence_id long, fill long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces that have (shard, item) as a key and a `length`.

    Every piece gets one place; a sequence holds at most `capacity` and has no gap. Full pieces are
    sequences of their own. Pieces of badly filled sequences of all shards are dealt to new shards of about
    SHARD_PIECES and packed again, as long as that saves a sequence. A table without rows gives none. The result depends on the pieces, their
    shards and fixed seeds only.
    """
    if pieces.where(F.col("length") > capacity).limit(1).count():
        raise ValueError("a piece is longer than a sequence")
    pieces = pieces.withColumn("_at", F.col("shard") * SHARD_PIECES + F.col("item"))
    full = pieces.where(F.col("length") == capacity).select(
        "_at", F.col("_at").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items = pieces.where(F.col("length") < capacity).select("shard", F.col("_at").alias("at"), "length")
    placed, level, handed = full, 0, None
    while True:
        packed = store(_pack_shards(open_items, capacity, level), "packed")
        poor = packed.where(F.col("fill") < GOOD_FILL * capacity)
        bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
        left = poor.agg(
            F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins"), F.count_distinct("shard").alias("shards")).first()
        # to deal again only helps where several shards have poor bins, and as long as it saves some
        again = left["shards"] > 1 and (handed is None or bins < handed)
        chosen = packed.where(F.col("fill") >= GOOD_FILL * capacity) if again else packed
        placed = placed.unionByName(chosen.select(F.col("at").alias("_at"), "sequence_id", "offset"))
        if not again:
            break
        handed, level = left["bins"], level + 1
        shards = math.ceil(left["n"] / SHARD_PIECES)  # no shard is larger than those before
        open_items = store(poor.select(
            F.pmod(F.xxhash64("at", F.lit(level)), F.lit(shards)).alias("shard"), "at", "length"), "poor")
    return pieces.join(placed, "_at").drop("_at")
