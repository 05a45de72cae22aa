"""Groups of similar items: candidates from shared keys, verified links, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.skew import BROADCAST_ROWS
from tracewright.plans.storage import materialize, store

SKETCH = 8  # longs of 64 bits that stand for a set
PAIRED = 128  # members of a bucket whose pairs are all looked at, if sketches of sets are known
_BEFORE = 8  # tokens before one that a row of the join on tokens has


def _same(before: tuple, after: DataFrame) -> tuple[bool, tuple]:
    row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row) == before, tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root): the smallest node reachable, for every node of an edge.

    Union-find by alternating stars: every node hands the smallest node it knows to its larger
    neighbours, then to its smaller ones, until the edges stay the same. The number of rounds grows
    with the logarithm of the largest component. Neighbours are never collected; only minima are
    aggregated, so a node of any degree is fine. Nulls and loops are left out.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    done, state = _same((), edges)
    while not done:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("_low"))
        large = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "_low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_low"))
        small = large.join(low, "a").select("b", "_low").where("b != _low").select(
            F.col("b").alias("a"), F.col("_low").alias("b"))
        edges = materialize(small.union(low.select("a", F.col("_low").alias("b"))).distinct())
        done, state = _same(state, edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())


def _pair_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (key, rid): every row whose key another row has, with the first rid of the key.

    The first and the last key of the partition also give a row with `edge`, as other partitions may have them.
    """

    def rows(key, rid, leader, edge):
        return pa.record_batch([pa.array(key, pa.int64()), pa.array(rid, pa.int64()), pa.array(leader, pa.int64()),
                                pa.array(np.full(len(key), edge), pa.bool_())], ["key", "rid", "leader", "edge"])

    last_key = last_rid = leader = None
    alone = False  # the current key had one row so far
    for batch in batches:
        key, rid = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(key):
            continue
        if last_key is None:
            yield rows(key[:1], rid[:1], rid[:1], True)
            last_key, last_rid, leader, alone = key[0], rid[0], rid[0], True
        new = (key != np.r_[last_key, key[:-1]]) | (rid != np.r_[last_rid, rid[:-1]])
        key, rid = key[new], rid[new]
        if not len(key):
            continue
        starts = key != np.r_[last_key, key[:-1]]
        at = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
        led = np.where(at < 0, leader, rid[at])
        shared = ~starts
        shared[:-1] |= starts[:-1] & (key[1:] == key[:-1])
        if alone and not starts[0]:
            yield rows([last_key], [leader], [leader], False)
        yield rows(key[shared], rid[shared], led[shared], False)
        alone = bool(starts[-1])
        last_key, last_rid, leader = key[-1], rid[-1], led[-1]
    if last_key is not None:
        yield rows([last_key], [leader], [leader], True)


def share_keys(keys: DataFrame) -> DataFrame:
    """(key, rid) -> (key, rid, leader) for all keys of two or more items; the smallest item leads.

    The rows are sorted by both columns over all partitions and each is held against its predecessor,
    so a frequent key is spread over as many partitions as it fills.
    """
    ordered = keys.repartitionByRange("key", "rid").sortWithinPartitions("key", "rid")
    found = store(ordered.mapInArrow(_pair_neighbours, "key long, rid long, leader long, edge boolean"), "shared-keys")
    edges = found.where("edge").groupBy("key").agg(
        F.min("leader").alias("leader"), F.array_sort(F.collect_set("rid")).alias("_all")).where(F.size("_all") > 1)
    across = edges.select("key", F.explode("_all").alias("rid"), "leader")  # a row per partition that has the key
    return found.where("not edge").drop("edge").unionByName(across)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if the rows, all of a few numbers, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def rare_token_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of items of different groups whose sets may have a similarity of `percent`.

    `sets` has (rid, token), distinct; `groups` (node, root). In the order of rising frequency, two
    sets that similar share one of their first n - ceil(percent * n / 100) + 1 tokens, so only those
    are joined, and of these only tokens that another set has. In families of items that share a core
    but are not similar enough the first tokens are each item's own, which leaves few pairs. Each item
    also has the parity of its tokens in SKETCH longs: two sets differ in at least as many tokens as
    their parities do in bits, so the join itself drops pairs that differ too much, however frequent the token.
    Similar sets share many tokens in a row, so each row also has the _BEFORE tokens before its own: a pair
    that shares one of these comes with that token, or with one before it, and not again with this one.
    """
    return _pairs_of_tokens(sets, groups, percent).distinct()


def _pairs_of_tokens(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    sets = store(sets, "sets")
    times = sets.groupBy("token").agg(F.count("*").alias("_times"))
    bit = F.xxhash64("token")
    parities = [F.bit_xor(F.when(F.pmod(bit, F.lit(SKETCH)) == i, F.expr("shiftleft(1L, cast(pmod(shiftright(_bit, 16), 64) as int))"))
                          .otherwise(F.lit(0).cast("long"))).alias(f"_p{i}") for i in range(SKETCH)]
    first = sets.join(times, "token").withColumn("_bit", bit).groupBy("rid").agg(
        F.count("*").alias("_n"), F.count_if(F.col("_times") == 1).alias("_own"),
        F.sort_array(F.collect_list(F.when(F.col("_times") > 1, F.struct("_times", "token")))).alias("_shared"), *parities)
    length = F.col("_n") - F.floor((F.col("_n") * percent + 99) / 100) + 1 - F.col("_own")
    bits = [f"_p{i}" for i in range(SKETCH)]
    rarest = F.slice("_shared", F.lit(1), length.cast("int"))["token"]
    prefix = first.where(length > 0).select("rid", "_n", *bits, rarest.alias("_rarest")).select(
        "rid", "_n", *bits, F.explode(F.transform("_rarest", lambda t, i: F.struct(t.alias("token"), F.slice(
            "_rarest", F.greatest(i - _BEFORE, F.lit(0)) + 1, F.least(i, F.lit(_BEFORE))).alias("before")))).alias("_at")).select(
        "rid", "_n", *bits, "_at.token", F.col("_at.before").alias("_before"))
    prefix = store(prefix.join(_small(groups).toDF("rid", "root"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid")), "prefixes")
    other = prefix.select("token", *[F.col(c).alias(f"_o{c}") for c in ("rid", "root", "_n", "_before", *bits)])
    differ = " + ".join(f"bit_count({c} ^ _o{c})" for c in bits)
    return prefix.join(other, "token").where(
        f"root < _oroot and 100 * least(_n, _o_n) >= {percent} * greatest(_n, _o_n) and {100 + percent} * ({differ}) <= {100 - percent} * (_n + _o_n) "
        "and not arrays_overlap(_before, _o_before)").select(
        F.least("rid", "_orid").alias("a"), F.greatest("rid", "_orid").alias("b"))


def may_be_similar(percent: int) -> str:
    """If two sets, of size n and _on and of parities sketch and _osketch, can have a similarity of `percent`."""
    differ = " + ".join(f"bit_count(sketch[{i}] ^ _osketch[{i}])" for i in range(SKETCH))
    return f"100 * least(n, _on) >= {percent} * greatest(n, _on) and {100 + percent} * ({differ}) <= {100 - percent} * (n + _on)"


def group_similar(
    keys: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int
) -> DataFrame:
    """Items that share a key and pass verification, directly or over others: (node, root).

    `keys` has (key, rid); all else is as in `group_members`.
    """
    return group_members(share_keys(keys), verify, sets, percent)


def group_members(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Members of buckets that pass verification, directly or over others: (node, root).

    `members` is what `share_keys` returns; `verify` takes pairs (a, b) with a < b and returns those that are linked;
    `sets` takes items (rid) and returns the tokens (rid, token) of their sets, which are linked from a
    similarity of `percent` on. `sketches` may have (rid, n, sketch), sizes and parities of the sets of all members.
    A link between items that share a key is never left out:

    1. In every bucket the smallest item leads; each item is verified against the leader it shares
       most keys with, then against its other leaders if they are still in another group.
    2. Of buckets that still hold several groups, all pairs whose sketches allow a link are verified if the bucket
       has at most PAIRED members and sketches are given.
    3. The members of all other such buckets are joined on their rarest tokens, and
       all pairs of different groups that this leaves are verified.

    So candidates grow with the members of a bucket, not with its pairs. Items without a link are not
    returned.
    """
    stars = store(members.where("rid != leader").groupBy(F.col("leader").alias("a"), F.col("rid").alias("b")).agg(
        F.count("*").alias("shared")), "stars")
    # the leader with most shared keys, of these the smallest
    most = stars.groupBy("b").agg(F.max("shared").alias("shared"))
    tested = store(stars.join(most, ["b", "shared"]).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tested")
    links = store(verify(tested), "links")
    roots = store(connected_components(links), "roots")

    def with_roots(pairs: DataFrame) -> DataFrame:
        known = _small(roots)
        return pairs.join(known.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left").join(
            known.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left").where(
            F.coalesce("_ra", "a") != F.coalesce("_rb", "b"))

    def by_roots(pairs: DataFrame) -> DataFrame:
        return with_roots(pairs).select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))

    def grow(pairs: DataFrame) -> None:
        """Verify the pairs of two groups that were not verified before; only groups are joined by what is new."""
        nonlocal tested, roots
        pairs = store(with_roots(pairs.join(tested, ["a", "b"], "left_anti")).select("a", "b"), "pairs")
        if pairs.isEmpty():
            return
        new = store(verify(pairs), "links")
        tested = tested.unionByName(pairs)
        if not new.isEmpty():
            joined = store(connected_components(by_roots(new)), "joined-roots")
            known = roots.join(_small(joined).toDF("root", "_top"), "root", "left").select(
                "node", F.coalesce("_top", "root").alias("root"))
            roots = store(known.unionByName(joined.join(roots.select("node"), "node", "left_anti")), "roots")

    grow(stars.select("a", "b"))
    apart = store(with_roots(stars.select("a", "b")).select(F.col("a").alias("leader"), F.col("b").alias("rid")), "apart")
    if apart.isEmpty():
        return roots
    # a pair of two items needs no other search: it was verified as leader and member
    sizes = members.groupBy("key").agg(F.count_distinct("rid").alias("_n")).where("_n > 2")
    open_keys = store(members.join(_small(apart), ["leader", "rid"], "left_semi").select("key").distinct().join(sizes, "key"), "open")
    if sketches is not None:
        few = open_keys.where(F.col("_n") <= PAIRED).select("key")
        own = members.select("key", "rid").join(_small(few), "key", "left_semi").join(sketches, "rid")
        other = own.select("key", F.col("rid").alias("_orid"), F.col("n").alias("_on"), F.col("sketch").alias("_osketch"))
        grow(own.join(other, "key").where(f"rid < _orid and {may_be_similar(percent)}").select(
            F.col("rid").alias("a"), F.col("_orid").alias("b")).distinct())
        open_keys = open_keys.where(F.col("_n") > PAIRED)
        if open_keys.isEmpty():
            return roots
    open_items = members.join(_small(open_keys.select("key")), "key", "left_semi")
    items = store(open_items.select("rid").union(open_items.select("leader")).distinct(), "open-items")
    grow(rare_token_pairs(sets(items), roots, percent))
    return roots
