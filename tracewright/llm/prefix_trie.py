"""Prefix trie of conversations: which share their first turns, and what sharing them saves.

Built by the recursion of van Emde Boas: sequences are cut at half depth, the prefixes up to the cut
get names, the truncated sequences make the upper trie and the rests below each name a forest, and
both are cut again. All segments of one size are cut in the same round. Equal contents below one name
are kept once with their number, so what conversations share is carried once. Down to segments of CHUNK
turns a round is a Spark job; below, a segment is a row, and its cuts are steps on arrays of a batch.

Totals take the same cuts: first those inside the small segments, where the path of a row passes
its sum on to the nodes above; then those of their roots, by jumps of doubling length; these are
grafted on the cut leaves of the segments above and passed on inside them.

A node goes by its smallest conversation and its depth. Sequences are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.storage import store

BITS = 6
CHUNK = 1 << BITS  # turns of a segment that is a row
MEMBERS = 256  # conversations whose ids are put into one text, by range of id
_WORD = r"[^\x20\x09-\x0D]+"
_VALUES = ("n_leaves", "saved_tokens")
_NAME = ("depth", "name_1", "name_2")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in the conversation (conv_id, place, mark_1, mark_2, words), and (conv_id, n_turns).

    Order is by turn, null first; turns of one number go by role, then text. Null role or text is the
    empty one. Rows without a conv_id are of no conversation and are left out. The rows are
    range-partitioned in that order and numbered inside each part, so a conversation of any size is
    spread over as many parts as it fills.
    """
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    empty = F.lit("")
    parts = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"))
    parts = store(parts.repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id()), "turns")
    sizes = parts.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("conv_id")
    sizes = store(sizes.select(
        "conv_id", "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("n_turns")), "parts")
    inside = Window.partitionBy("conv_id", "_part").orderBy(*order)
    placed = parts.withColumn("_at", F.row_number().over(inside)).join(sizes, ["conv_id", "_part"]).select(
        "conv_id", (F.col("_before") + F.col("_at")).alias("place"),
        *[F.xxhash64(F.lit(i), "role", "text").alias(f"mark_{i}") for i in (1, 2)],
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))
    return store(placed, "places"), sizes.where("_before = 0").select("conv_id", "n_turns")


def _combined(*of: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), *of).alias(f"mark_{i}") for i in (1, 2)]


def _chunks(sequences: DataFrame) -> DataFrame:
    """Segments of CHUNK turns: conv_id, block, their turns in order, and their content (n, mark_1, mark_2, words)."""
    rows = sequences.groupBy("conv_id", F.shiftright(F.col("place") - 1, BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "mark_1", "mark_2", "words"))).alias("turns"))
    return store(rows.select(
        "conv_id", "block", "turns", F.size("turns").cast("long").alias("n"),
        *[F.xxhash64(F.lit(i), "turns.mark_1", "turns.mark_2").alias(f"mark_{i}") for i in (1, 2)],
        F.aggregate("turns.words", F.lit(0).cast("long"), lambda a, w: a + w).alias("words")), "chunks")


def _blocks(last: DataFrame, levels: int) -> list[DataFrame]:
    """For each level from 1 on, the blocks of 2**level chunks with their halves and their content."""
    content = F.struct("n", "mark_1", "mark_2", "words")
    out = []
    for _ in range(levels):
        odd = F.col("block") % 2 == 1
        halves = last.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~odd, content)).alias("left"), F.max(F.when(odd, content)).alias("right"))
        last = store(halves.select(
            "conv_id", "block", "left", "right", (F.col("left.n") + F.coalesce("right.n", F.lit(0))).alias("n"),
            *_combined(F.col("left.mark_1"), F.col("left.mark_2"), F.col("right.mark_1"), F.col("right.mark_2")),
            (F.col("left.words") + F.coalesce("right.words", F.lit(0))).alias("words")), "blocks")
        out.append(last)
    return out


def _merged(segments: DataFrame) -> DataFrame:
    """Equal contents below the same name once, with their smallest conversation and their number."""
    return segments.groupBy("block", "name_1", "name_2", "content").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))


def _segments(whole: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """From whole sequences to chunks: a row for each name of a prefix of `block` chunks and content that goes on from it."""
    zero = F.lit(0).cast("long")
    segments = _merged(whole.select(
        "conv_id", zero.alias("block"), zero.alias("name_1"), zero.alias("name_2"), "content", F.lit(1).cast("long").alias("n_convs")))
    for level in reversed(range(len(blocks))):
        halves = segments.drop("content").join(blocks[level].select("conv_id", "block", "left", "right"), ["conv_id", "block"], "left")
        names = [F.xxhash64(F.lit(i), "name_1", "name_2", "left.mark_1", "left.mark_2").alias(f"name_{i}") for i in (1, 2)]
        upper = F.struct((F.col("block") * 2).alias("block"), "name_1", "name_2", F.col("left").alias("content"))
        lower = F.struct((F.col("block") * 2 + 1).alias("block"), *names, F.col("right").alias("content"))
        cut = F.array_compact(F.array(upper, F.when(F.col("left.n") == 1 << level + BITS, lower)))
        segments = store(_merged(halves.select("conv_id", "n_convs", F.inline(cut))), "segments")
    return segments


def _mix(seed: int, *of: np.ndarray) -> np.ndarray:
    """A 64-bit hash of some 64-bit numbers, each in its place."""
    z = np.full(of[0].shape, seed * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for x in of:
        z = (z ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def prefix_names(roots: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Names of the prefixes of 0 to CHUNK - 1 turns: [pair, row, length], from names of rows' roots and marks of turns.

    Contents of halves are combined from single turns up, then cut prefixes are named from the whole
    segment down: each by the name its half starts with and the content before the cut.
    """
    contents = [marks]
    for _ in range(BITS - 1):
        a, b = contents[-1][:, :, ::2], contents[-1][:, :, 1::2]
        contents.append(np.stack([_mix(seed, a[0], a[1], b[0], b[1]) for seed in (1, 2)]))
    names = np.zeros_like(marks)
    names[:, :, 0] = roots
    for level in reversed(range(BITS)):
        start, content = names[:, :, ::2 << level], contents[level][:, :, ::2]
        names[:, :, 1 << level::2 << level] = np.stack(
            [_mix(seed, start[0], start[1], content[0], content[1]) for seed in (3, 4)])
    return names


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the names of all prefixes that start in a chunk, as two arrays, to rows of conv_id, block, n_convs, names, turns."""
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        turns = column["turns"]
        sizes = np.array([len(t) if t is not None else 0 for t in turns.to_pylist()], np.int64)
        filled = np.arange(CHUNK) < sizes[:, None]
        marks = np.zeros((2, batch.num_rows, CHUNK), np.uint64)
        flat = turns.flatten()
        for i in (0, 1):
            marks[i][filled] = flat.field(f"mark_{i + 1}").to_numpy(zero_copy_only=False).view(np.uint64)
        roots = np.stack([column[f"name_{i}"].to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2)])
        names = prefix_names(roots, marks).view(np.int64)
        lengths = np.minimum(sizes + 1, CHUNK)  # where a sequence ends inside, the prefix of all its turns too
        ends = np.r_[0, np.cumsum(lengths)]
        starts_here = np.arange(CHUNK) < lengths[:, None]
        yield pa.RecordBatch.from_arrays(
            [column["conv_id"], column["block"], column["n_convs"], turns,
             *[pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[i][starts_here])) for i in (0, 1)]],
            names=["conv_id", "block", "n_convs", "turns", "names_1", "names_2"])


def _paths(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """The segments with their turns and the names of the prefixes that start in them."""
    rows = segments.select("conv_id", "block", "n_convs", "name_1", "name_2").join(
        chunks.select("conv_id", "block", "turns"), ["conv_id", "block"], "left")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("name_1", "name_2"))
    return store(rows.mapInArrow(_named, f"{fields}, names_1 array<long>, names_2 array<long>"), "paths")


def _edges(paths: DataFrame) -> DataFrame:
    """A row for each prefix (name, depth) and turn that goes on from it; where sequences end, that turn is null."""
    step = F.posexplode(F.arrays_zip("names_1", "names_2"))
    rows = paths.select("conv_id", "block", "n_convs", "turns", step)
    return store(rows.select(
        "conv_id", "n_convs", (F.col("block") * CHUNK + F.col("pos")).alias("depth"),
        F.col("col.names_1").alias("name_1"), F.col("col.names_2").alias("name_2"), F.get("turns", "pos").alias("_turn"),
    ).select(
        "conv_id", "n_convs", *_NAME, F.when(F.col("_turn").isNotNull(), F.struct("_turn.mark_1", "_turn.mark_2", "_turn.words")).alias("content"),
    ).groupBy(*_NAME, "content").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")), "edges")


def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of names and values at places of a path, a row per name: the sum of the values there and below.

    The values are at the places from the first one given on; all names before them get the whole sum.
    """
    for batch in batches:
        block, first, second, at, leaves, saved = (c.to_pylist() for c in batch.columns)
        out = []
        for b, n_1, n_2, places, x, y in zip(block, first, second, at, leaves, saved, strict=True):
            sums, here = (0, 0), dict(zip(places, zip(x, y, strict=True), strict=True))
            for place in range(len(n_1) - 1, -1, -1):
                more = here.get(place, (0, 0))
                sums = sums[0] + more[0], sums[1] + more[1]
                if sums != (0, 0):
                    out.append((b * CHUNK + place, n_1[place], n_2[place], *sums))
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*_NAME, *_VALUES])


def _climb(rows: DataFrame) -> DataFrame:
    """`_climbed` of rows with block, names_1, names_2 and `values` (place, n_leaves, saved_tokens)."""
    fields = ", ".join(f"{n} long" for n in (*_NAME, *_VALUES))
    return rows.select(
        "block", "names_1", "names_2", "values.place", *[f"values.{v}" for v in _VALUES]).mapInArrow(_climbed, fields)


def _jumps(nodes: DataFrame, levels: int, offset: int) -> list[DataFrame]:
    """For each level the ancestors 2**level above of the nodes whose depth plus `offset` is a multiple of that: conv_id, depth, up."""
    last = nodes.where("depth > 0").select("conv_id", "depth", F.col("parent_conv_id").alias("up"))
    out = [last]
    for level in range(1, levels):
        high = last.select(F.col("conv_id").alias("up"), (F.col("depth") + (1 << level - 1)).alias("depth"), F.col("up").alias("_upper"))
        last = store(last.where((F.col("depth") + offset) % (1 << level) == 0).join(high, ["up", "depth"]).select(
            "conv_id", "depth", F.col("_upper").alias("up")), "jumps")
        out.append(last)
    return out


def _totals(nodes: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth) and the sums of _VALUES over the subtree of each node, in `levels` rounds up and as many down."""
    key = ["conv_id", "depth"]

    def lifted(rows: DataFrame, jumps: DataFrame, step: int) -> DataFrame:
        """Sums of the rows by their ancestor `step` above."""
        return rows.join(jumps, key).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(
            *[F.sum(v).alias(v) for v in _VALUES])

    def added(*rows: DataFrame) -> DataFrame:
        union = rows[0]
        for more in rows[1:]:
            union = union.unionByName(more)
        return store(union.groupBy(*key).agg(*[F.sum(v).alias(v) for v in _VALUES]), "totals")

    own = nodes.select(*key, *_VALUES)
    tops, bottoms = _jumps(nodes, levels, 0), _jumps(nodes, levels, 1)
    # from the bottom: what a segment of 2**level depths holds below its root, of all segments of that size
    roots = [own]
    for level in range(levels - 1):
        size = 1 << level
        lower = F.shiftright("depth", level) % 2 == 1
        roots.append(added(roots[-1].where(~lower), lifted(roots[-1].where(lower), tops[level], size)))
    # from the top: what hangs below the last depth of a segment
    below = own.where("false")
    for level in reversed(range(levels)):
        size = 1 << level
        grafts = lifted(roots[level].where(F.shiftright("depth", level) % 2 == 1), tops[0], 1)
        below = added(below, lifted(below, bottoms[level], size), grafts)
    return added(own, below)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their key, the hash of each key's texts joined by commas; a row for each key at its end."""
    current, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k], pa.int64()) for k in current], pa.array([digest.hexdigest()], pa.string())],
            names=["n", "mark_1", "mark_2", "ends_sha256"])

    for batch in batches:
        for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == current:
                digest.update(b",")
            else:
                if current is not None:
                    yield row()
                current, digest = key, hashlib.sha256()
            digest.update(text.encode())
    if current is not None:
        yield row()


def _ends(whole: DataFrame) -> DataFrame:
    """Per different whole sequence: its smallest conversation, length, and the hash of the ids of its conversations.

    Ids are put together by ranges of MEMBERS of them, so that no list grows with the number of equal
    conversations; the hash reads those texts one after another.
    """
    key = ["n", "mark_1", "mark_2"]
    known = whole.select("conv_id", *[F.coalesce(f"content.{k}", F.lit(0).cast("long")).alias(k) for k in key])
    texts = known.groupBy(*key, F.floor(F.col("conv_id") / MEMBERS).alias("_range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    hashes = texts.repartition(*key).sortWithinPartitions(*key, "_range").select(*key, "ids").mapInArrow(
        _hashed, "n long, mark_1 long, mark_2 long, ends_sha256 string")
    return known.groupBy(*key).agg(F.min("conv_id").alias("conv_id")).join(hashes, key).select(
        "conv_id", F.col("n").alias("depth"), "ends_sha256")


def _all_totals(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Names and the sums of _VALUES over their subtrees. `nodes` has names, conv_id and _VALUES."""
    place = (F.col("depth") % CHUNK).cast("int").alias("place")
    own = nodes.groupBy("conv_id", F.shiftright("depth", BITS).alias("block")).agg(
        F.collect_list(F.struct(place, *_VALUES)).alias("values"))  # at most CHUNK
    inside = _climb(paths.join(own, ["conv_id", "block"]))
    if levels:
        # the roots of segments as a trie of their own
        inside = store(inside, "inside")
        root = nodes.where(F.col("depth") % CHUNK == 0).select("conv_id", F.shiftright("depth", BITS).alias("block"), *_NAME)
        above = paths.select(
            "conv_id", (F.col("block") + 1).alias("block"), (F.col("block") * CHUNK).alias("depth"),
            F.get("names_1", F.lit(0)).alias("name_1"), F.get("names_2", F.lit(0)).alias("name_2"))
        above = above.join(root.select(*_NAME, F.col("conv_id").alias("parent_conv_id")), list(_NAME)).select("conv_id", "block", "parent_conv_id")
        held = inside.groupBy(*_NAME).agg(*[F.sum(v).alias(v) for v in _VALUES])
        roots = store(root.join(held, list(_NAME), "left").join(above, ["conv_id", "block"], "left").select(
            "conv_id", F.col("block").alias("depth"), "parent_conv_id",
            *[F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in _VALUES]), "roots")
        below = _totals(roots, levels).where("depth > 0").select(
            "conv_id", (F.col("depth") - 1).alias("block"),
            F.array(F.struct(F.lit(CHUNK - 1).alias("place"), *_VALUES)).alias("values"))
        inside = inside.unionByName(_climb(paths.join(below, ["conv_id", "block"])))
    return inside.groupBy(*_NAME).agg(*[F.sum(v).alias(v) for v in _VALUES])


def trie(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `sequences` has conv_id, place (from 1, without gaps), mark_1, mark_2 (what turns are compared by) and
    words; `conversations` has the conv_id of every conversation, those without a turn too, once each.
    The root has depth 0 and no parent. n_leaves and saved_tokens are sums over the subtree: of nodes
    without children, and of (n_convs - 1) times the words of the node's turn. ends_sha256 hashes the ids
    of the conversations that end at the node, ascending and joined by commas. Without conversations
    there are no nodes.
    """
    chunks = _chunks(sequences)
    most = chunks.agg(F.max(F.col("block") * CHUNK + F.col("n"))).first()[0] or 0
    levels = (most >> BITS).bit_length()
    top = [chunks, *_blocks(chunks, levels)]
    content = F.when(F.col("n").isNotNull(), F.struct("n", "mark_1", "mark_2", "words"))
    whole = store(conversations.select("conv_id").join(
        top[-1].where("block = 0"), "conv_id", "left").select("conv_id", content.alias("content")), "whole")
    paths = _paths(_segments(whole, top[1:]), chunks)
    edges = _edges(paths)
    named = store(edges.groupBy(*_NAME).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("content").alias("n_children")), "names")
    # the smallest conversation of an edge is that of the node it leads to
    below = edges.join(named.select(*_NAME, F.col("conv_id").alias("parent_conv_id")), list(_NAME))
    children = below.where("content is not null").select(
        "conv_id", (F.col("depth") + 1).alias("depth"), "parent_conv_id", F.col("content.words").alias("_words"))
    key = ["conv_id", "depth"]
    ends = below.where("content is null").select(*key, F.col("parent_conv_id").alias("_of")).join(
        _ends(whole), key).select(F.col("_of").alias("conv_id"), "depth", "ends_sha256")
    nodes = store(named.join(children, key, "left").select(
        *_NAME, "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("_words", F.lit(0))).alias("saved_tokens")), "nodes")
    none = F.lit(hashlib.sha256().hexdigest())
    totals = _all_totals(nodes, paths, levels)
    return nodes.drop(*_VALUES).join(totals, list(_NAME), "left").join(ends, key, "left").select(
        *key, "parent_conv_id", "n_convs", "n_children",
        *[F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in _VALUES], F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) as they are: see `numbered` and `trie`.

    Repeated rows are turns of their own; other columns are ignored; no rows give no nodes.
    """
    sequences, conversations = numbered(turns)
    return trie(sequences, conversations)
