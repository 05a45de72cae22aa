"""Loops of a model: arcs back to the same or to an earlier activity.

The state of the search is the arc table of the model and one row per activity; events play no part in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.arcs import ARC
from tracewright.plans.skew import join_lookup
from tracewright.plans.storage import store
from tracewright.spec import ACTIVITY, START_TASK

HOPS = 4  # steps along the arcs in one job
DOUBLINGS = 3
PAIRWISE = 2_000  # most arcs of a model whose pairs of activities are all looked at


def _spread(state: DataFrame, arcs: DataFrame, keys: Sequence[str], n_arcs: int) -> DataFrame:
    """One hop: the greatest label that leads here and that can be reached from here, and the distance from START."""
    own = state.select(*keys, "node", "ahead", "behind", "depth", "old")
    none = F.lit(None)
    on = arcs.withColumnRenamed("src", "node")
    forward = join_lookup(own, on, [*keys, "node"], rows=n_arcs).select(
        *keys, F.col("dst").alias("node"), "ahead", none.cast("long").alias("behind"), (F.col("depth") + 1).alias("depth"),
        none.cast(own.schema["old"].dataType).alias("old"))
    on = arcs.withColumnRenamed("dst", "node")
    backward = join_lookup(own, on, [*keys, "node"], rows=n_arcs).select(
        *keys, F.col("src").alias("node"), none.cast("long").alias("ahead"), "behind", none.cast("int").alias("depth"),
        none.cast(own.schema["old"].dataType).alias("old"))
    return own.unionByName(forward).unionByName(backward).groupBy(*keys, "node").agg(
        F.max("ahead").alias("ahead"), F.max("behind").alias("behind"), F.min("depth").alias("depth"), F.max("old").alias("old"))


def components(arcs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`node, component, depth`: strongly connected components, and the distance from START (null if out of reach).

    Every activity has a label, a hash of its name and of the round. The greatest label that reaches an
    activity and the greatest one that it reaches are spread along the arcs until nothing changes. Activities
    of one component agree in both, so arcs between others are left out, and the rest is labelled anew. A
    component is found when both are the same label. HOPS steps are one job, and a round splits what is left
    at random, so rounds grow with the logarithm of the activities. The component is the smallest name in it.
    """
    arcs = store(arcs.select(*keys, *ARC).where("src <> dst").distinct(), "arcs")
    inner, n_arcs = arcs, arcs.count()
    nodes = arcs.select(*keys, F.explode(F.array(*ARC)).alias("node")).distinct()
    depth = F.when(F.col("node") == START_TASK, 0)
    parts = nodes.withColumns({"part": F.lit(0).cast("long"), "depth": depth.cast("int")})
    done, round_, left = None, 0, True
    while left:
        label = F.xxhash64(F.lit(round_), "node")
        state = parts.withColumns({"ahead": label, "behind": label}).withColumn("old", F.struct("ahead", "behind", "depth"))
        changed = n_arcs > 0
        while changed:
            for _ in range(HOPS):
                state = _spread(state, inner, keys, n_arcs)
            state = store(state, "labels")
            new = F.struct("ahead", "behind", "depth")
            changed = not state.where(~F.col("old").eqNullSafe(new)).isEmpty()
            state = state.withColumn("old", new)
        # the distance is only complete in the first round, when no arc is left out
        depths = state.select(*keys, "node", "depth") if done is None else depths
        parted = state.select(*keys, "node", F.xxhash64("ahead", "behind").alias("part"), (F.col("ahead") == F.col("behind")).alias("found"))
        # of a part whose labels agree, those are the component of the label
        found = parted.where("found").select(*keys, "node", "part", F.lit(round_).alias("round"))
        done = found if done is None else done.unionByName(found)
        open_ = parted.where("not found").select(*keys, "node", "part")
        ends = [open_.select(*keys, F.col("node").alias(e), F.col("part").alias(f"_{e}")) for e in ARC]
        inner = store(inner.join(ends[0], [*keys, "src"]).join(ends[1], [*keys, "dst"]).where("_src = _dst").select(*keys, *ARC), "arcs")
        n_arcs = inner.count()
        if not n_arcs:  # what is open has no arc inside its part: components of one activity
            done, left = done.unionByName(open_.select(*keys, "node", F.xxhash64("node", "part").alias("part"), F.lit(round_).alias("round"))), False
        else:
            inside = inner.select(*keys, F.explode(F.array(*ARC)).alias("node")).distinct()
            alone = open_.join(inside, [*keys, "node"], "left_anti")
            done = done.unionByName(alone.select(*keys, "node", F.xxhash64("node", "part").alias("part"), F.lit(round_).alias("round")))
            parts = open_.join(inside, [*keys, "node"], "left_semi").withColumn("depth", F.lit(None).cast("int"))
        round_ += 1
    found = store(done, "components")
    names = found.groupBy(*keys, "round", "part").agg(F.min("node").alias("component"))
    return found.join(names, [*keys, "round", "part"]).join(depths, [*keys, "node"]).select(*keys, "node", "component", "depth")


def _rank(end: str) -> Column:
    """Depth, then name; what START does not reach comes last."""
    return F.struct(F.coalesce(f"{end}_depth", F.lit(2**31 - 1)), F.col(end))


def distances(arcs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`src, dst, distance` of every pair of activities of which one reaches the other.

    Paths of twice the length are put together from two, DOUBLINGS times in a job. For models of few
    activities, since there can be as many rows as pairs of them.
    """
    paths, covered, longest = arcs.select(*keys, *ARC).where("src <> dst").distinct().withColumn("distance", F.lit(1)), 1, 1
    while longest >= covered:
        for _ in range(DOUBLINGS):
            on = paths.select(*keys, F.col("src").alias("_mid"), F.col("dst").alias("_dst"), F.col("distance").alias("_more"))
            longer = paths.withColumnRenamed("dst", "_mid").join(on, [*keys, "_mid"]).where("src <> _dst").select(
                *keys, "src", F.col("_dst").alias("dst"), (F.col("distance") + F.col("_more")).alias("distance"))
            paths = paths.unionByName(longer).groupBy(*keys, *ARC).agg(F.min("distance").alias("distance"))
        paths, covered = store(paths, "distances"), covered << DOUBLINGS
        # a pair at some distance means pairs at all shorter ones: below what is covered there is nothing left to find
        longest = paths.agg(F.max("distance")).first()[0] or 0
    return paths


def loops(arcs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`kind, src, dst`: arcs onto themselves (`self`) and back to an earlier activity (`return`).

    An arc closes a loop if its ends are in one strongly connected component, that is, if its source can
    be reached from its destination. Of two activities the one fewer arcs away from START is the earlier,
    at the same distance the one whose name comes first. So every loop has a return arc, also between
    activities that START reaches alike. Models of up to PAIRWISE arcs are solved by `distances`, larger ones by `components`.
    """
    arcs = store(arcs.select(*keys, *ARC), "arcs")
    across = arcs.where("src <> dst")
    if arcs.count() <= PAIRWISE:
        reach = distances(arcs, keys)
        closed = across.join(reach.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("src")), [*keys, *ARC], "left_semi")
        start = arcs.where(F.col("src") == START_TASK).select(*keys, F.col("src").alias("node"), F.lit(0).alias("depth")).distinct()
        depth = reach.where(F.col("src") == START_TASK).select(*keys, F.col("dst").alias("node"), F.col("distance").alias("depth"))
        depth = depth.unionByName(start)
        for end in ARC:
            closed = closed.join(depth.select(*keys, F.col("node").alias(end), F.col("depth").alias(f"{end}_depth")), [*keys, end], "left")
    else:
        placed = components(arcs, keys)
        closed = across
        for end in ARC:
            closed = closed.join(placed.select(
                *keys, F.col("node").alias(end), F.col("component").alias(f"{end}_of"), F.col("depth").alias(f"{end}_depth")), [*keys, end])
        closed = closed.where("src_of = dst_of")
    back = closed.where(_rank("dst") < _rank("src")).select(*keys, *ARC)
    return (
        arcs.where("src = dst").withColumn("kind", F.lit("self"))
        .unionByName(back.withColumn("kind", F.lit("return")))
        .select(*keys, "kind", *ARC)
    )


def loop_nodes(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The activities that loop arcs leave from, by kind."""
    return found.select(*keys, "kind", F.col("src").alias(ACTIVITY)).distinct()


def loop_share(found: DataFrame, frequencies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frequency of each loop arc (0 if no case used it) and its percentage of all arc uses of the slice."""
    frequency = F.coalesce("frequency", F.lit(0).cast("long"))
    if keys:
        totals = frequencies.groupBy(*keys).agg(F.sum("frequency").alias("_total"))
        rated = found.join(totals, list(keys), "left")
        total = F.col("_total")
    else:
        rated, total = found, frequencies.agg(F.sum("frequency")).scalar()
    return rated.join(frequencies.select(*keys, *ARC, "frequency"), [*keys, *ARC], "left").select(
        *keys, "kind", *ARC, frequency.alias("frequency"), (frequency / total * 100).alias("share"))
