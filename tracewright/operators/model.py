"""Discovery of a process model from dependencies between activities.

The measures are those of the heuristics-miner family: how much more often b follows a than a
follows b, with all activities kept connected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.arcs import ARC
from tracewright.operators.sequence import case_count, with_names
from tracewright.operators.variants import VARIANT
from tracewright.plans.skew import with_neighbours
from tracewright.plans.storage import materialize
from tracewright.spec import ACTIVITY, END_TASK, POS, START_TASK, TRACE

THRESHOLD = 0.9  # least dependency, loops of length one and two included


def dependencies(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`src, dst, frequency, dependency, two_step` of every pair that follows each other.

    Sequences are those with START and END. Each event is counted once by itself and its neighbours,
    which yields all counts in one pass; both directions of a pair then meet in one row, so nothing
    is joined.
    """
    near = with_neighbours(with_names(events), before=[ACTIVITY], after=[ACTIVITY], by=[*keys, TRACE])
    around = near.groupBy(
        *keys, F.when(F.col("is_first"), START_TASK).otherwise(F.col(f"prev_{ACTIVITY}")).alias("_before"),
        F.col(ACTIVITY).alias("_at"),
        F.when(F.col("is_last"), END_TASK).otherwise(F.col(f"next_{ACTIVITY}")).alias("_after"),
    ).agg(F.count("*").alias("_n"))

    def counts(condition: Column, src: str, dst: str, step: Column, back_and_forth: Column) -> Column:
        return F.when(condition, F.struct(
            F.least(src, dst).alias("_low"), F.greatest(src, dst).alias("_high"),
            F.when(F.col(src) <= F.col(dst), step).otherwise(0).alias("_ab"),
            F.when(F.col(src) > F.col(dst), step).otherwise(0).alias("_ba"),
            back_and_forth.alias("_round")))

    n, none = F.col("_n"), F.lit(0).cast("long")
    found = F.array(
        counts(F.lit(True), "_at", "_after", n, none),
        counts(F.col("_before") == START_TASK, "_before", "_at", n, none),
        counts(F.col("_before") == F.col("_after"), "_before", "_at", none, n))
    pairs = around.select(*keys, F.inline(F.array_compact(found))).groupBy(*keys, "_low", "_high").agg(
        *[F.sum(c).alias(c) for c in ("_ab", "_ba", "_round")])
    low, high, self = F.col("_low"), F.col("_high"), F.col("_low") == F.col("_high")
    ab, ba = F.col("_ab"), F.col("_ba")

    def direction(src: Column, dst: Column, there: Column, back: Column) -> Column:
        return F.struct(
            src.alias("src"), dst.alias("dst"), there.alias("frequency"),
            F.when(self, there / (there + 1.0)).otherwise((there - back) / (there + back + 1.0))
            .alias("dependency"),
            F.when(self, 0.0).otherwise(F.col("_round") / (F.col("_round") + 1.0)).alias("two_step"))

    both = F.array(direction(low, high, ab, ba), direction(high, low, ba, ab))
    return pairs.select(*keys, F.inline(both)).where("frequency > 0")


def dependency_graph(
    events: DataFrame, threshold: float = THRESHOLD, connect_all: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """The arcs of the model: `src, dst, frequency, dependency`.

    An arc is kept for its dependency, or with its reverse for a two-step loop between activities
    that are no self-loops. With `connect_all`, an activity left without an arc to (or from) another
    one gets its best. The windows run on one row per pair, so none holds more rows than there are
    activities.
    """
    keys = list(keys)
    strong = F.col("dependency") >= threshold
    self = F.col("src") == F.col("dst")
    ends = {end: Window.partitionBy(*keys, end) for end in ARC}
    judged = dependencies(events, keys)
    for end, window in ends.items():
        judged = judged.withColumn(f"_{end}_loops", F.max(self & strong).over(window))
    short = (F.col("two_step") >= threshold) & ~F.col("_src_loops") & ~F.col("_dst_loops")
    judged = judged.withColumn("_kept", strong | short)
    if connect_all:
        best = F.lit(False)
        for end, other in (("dst", "src"), ("src", "dst")):
            rank = F.struct(-F.col("dependency"), -F.col("frequency"), F.col(other))
            judged = judged.withColumns({
                f"_{end}_served": F.max(F.col("_kept") & ~self).over(ends[end]),
                f"_{end}_best": F.min(F.when(~self, rank)).over(ends[end]),
            })
            best = best | (~F.col(f"_{end}_served") & ~self & (rank == F.col(f"_{end}_best")))
        judged = judged.where(F.col("_kept") | best)
    else:
        judged = judged.where("_kept")
    return judged.select(*keys, *ARC, "frequency", "dependency")


def bindings(arcs_of_cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Input and output sets of each activity with how often each was used: `activity, side, members, n`.

    The output set of an event is what its arcs lead to, the input set where they come from. A set
    is never larger than the number of arcs the activity has in the model.
    """
    per_event = [
        arcs_of_cases.groupBy(*keys, VARIANT, F.col(own_pos).alias(POS), F.col(own).alias(ACTIVITY), "reps").agg(
            F.sort_array(F.collect_set(other)).alias("members")).withColumn("side", F.lit(side))
        for side, own, own_pos, other in (("out", "src", "src_pos", "dst"), ("in", "dst", POS, "src"))
    ]
    return per_event[0].unionByName(per_event[1]).groupBy(*keys, ACTIVITY, "side", "members").agg(
        F.sum("reps").alias("n"))


def clean_model(arcs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leave out activities whose only arc is onto themselves; those without any are in no arc."""
    linked = arcs.where("src <> dst").select(*keys, F.explode(F.array(*ARC)).alias("src")).distinct()
    return arcs.join(linked, [*keys, "src"], "left_semi").select(*arcs.columns)


def discover(events: DataFrame, threshold: float = THRESHOLD, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """`edges` and `nodes` of the model, ready to be drawn. The edges are found once and stored."""
    edges = materialize(clean_model(dependency_graph(events, threshold, keys=keys), keys))
    return {"edges": edges, "nodes": model_nodes(events, edges, keys)}


def model_nodes(events: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The activities in a model with their frequency; START and END count the cases."""
    ends = F.explode(F.array(F.lit(START_TASK), F.lit(END_TASK))).alias(ACTIVITY)
    counted = with_names(events).groupBy(*keys, ACTIVITY).agg(F.count("*").alias("frequency")).unionByName(
        case_count(events, keys).select(*keys, ends, F.col("n_cases").alias("frequency")))
    used = edges.select(*keys, F.explode(F.array(*ARC)).alias(ACTIVITY)).distinct()
    return counted.join(used, [*keys, ACTIVITY], "left_semi")


def highlight(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """Every model arc with whether it is among the marked arcs of a pattern or path."""
    flags = marked.select(*ARC).distinct().withColumn("_in", F.lit(True))
    return edges.join(flags, list(ARC), "left").withColumn("in_pattern", F.col("_in").isNotNull()).drop("_in")


def highlight_nodes(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Every model activity with whether a marked arc touches it."""
    flags = marked.select(F.explode(F.array(*ARC)).alias(ACTIVITY)).distinct().withColumn("_in", F.lit(True))
    return nodes.join(flags, ACTIVITY, "left").withColumn("in_pattern", F.col("_in").isNotNull()).drop("_in")


def highlight_patterns(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every model arc once for each pattern it is in, with `threshold` and the `arcs` of the pattern.

    An arc that no pattern holds has one row without them.
    """
    marks = patterns.select("threshold", "arcs", F.explode("arcs").alias("_arc")).select("threshold", "arcs", "_arc.*")
    return edges.join(marks, list(ARC), "left")
