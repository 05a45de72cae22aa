"""Arcs: transitions between activities, their frequency, duration and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.activity import duration_summary
from tracewright.operators.sequence import with_names
from tracewright.operators.variants import VARIANT, variant_events, variants
from tracewright.plans.skew import join_lookup, sliced, with_latest, with_neighbours
from tracewright.spec import ACTIVITY, COMPLETE, POS, SEQ, START, TRACE

ARC = ("src", "dst")
STATE = 128  # activities whose last places one window keeps


def directly_follows(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often one activity comes right after another in a case: `src, dst, frequency`."""
    steps = with_neighbours(with_names(events), after=[ACTIVITY], by=[*keys, TRACE]).where(~F.col("is_last"))
    return steps.groupBy(*keys, F.col(ACTIVITY).alias("src"), F.col(f"next_{ACTIVITY}").alias("dst")).agg(
        F.count("*").alias("frequency"))


def case_arcs(
    events: DataFrame, model: DataFrame, mode: str = "latest", chosen: DataFrame | None = None, few: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The model arcs each event of a variant is reached by: `variant_id, src_pos, pos, src, dst, reps`.

    Event y takes as source the latest earlier x of each model arc (x, y), unless another y lies
    between them and has used it up already. `mode="directly_follows"` only takes sources right before
    the event in the whole case. `chosen` restricts the variants; `few` says that they are a handful.
    With `keys` the model has them too, and each slice of the log is held against its own arcs.

    The place where each activity was last seen comes from the window that puts the events in order, so
    nothing is shuffled by arc. That is an array of one place for each activity of the model; beyond
    STATE activities, events are spread over the arcs they touch instead.
    """
    chosen = variants(events, keys) if chosen is None else chosen
    placed = variant_events(with_names(events), chosen, keys, dummies=True, few=few)
    arcs = model.select(*keys, *ARC)
    by = [*keys, VARIANT]
    columns = [*by, "src_pos", POS, *ARC, "reps"]
    if mode == "directly_follows":
        near = with_neighbours(placed, before=[ACTIVITY, POS], by=by, order=[POS]).where("not is_first")
        near = near.withColumnsRenamed({f"prev_{ACTIVITY}": "src", f"prev_{POS}": "src_pos", ACTIVITY: "dst"})
        return join_lookup(near, arcs, [*keys, *ARC]).select(*columns)
    names = [r[0] for r in arc_nodes(arcs).orderBy(ACTIVITY).limit(STATE + 1).collect()]
    if not names:
        return placed.where("false").withColumns({"src_pos": F.col(POS), "src": F.col(ACTIVITY), "dst": F.col(ACTIVITY)}).select(*columns)
    if len(names) > STATE:
        return _spread_over_arcs(placed, arcs, keys, columns)
    seen = with_latest(placed, [F.when(F.col(ACTIVITY) == n, F.col(POS)) for n in names], "_seen", by=by, order=[POS])
    known = arcs.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "src string, _at int")
    into = arcs.join(F.broadcast(known), "src").groupBy(*keys, "dst").agg(F.collect_list(F.struct("src", "_at")).alias("_from"))
    into = into.join(F.broadcast(known.withColumnsRenamed({"src": "dst", "_at": "_own"})), "dst").withColumnRenamed("dst", ACTIVITY)
    used = F.element_at("_seen", F.col("_own"))
    met = F.transform("_from", lambda x: F.struct(x["src"].alias("src"), F.element_at("_seen", x["_at"]).alias("src_pos")))
    open_ = F.filter(met, lambda x: x["src_pos"].isNotNull() & (used.isNull() | (x["src_pos"] >= used)))
    return join_lookup(seen, into, [*keys, ACTIVITY]).select(
        *by, POS, F.col(ACTIVITY).alias("dst"), "reps", F.inline(open_)).select(*columns)


def _spread_over_arcs(placed: DataFrame, arcs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`case_arcs` for models of very many activities.

    Seen from the arc (x, y), y takes a source if, among the events of the case that are x or y, the one right
    before it is x. So events are spread over the arcs they touch and compared with the one before.
    """
    ends = arcs.select(*keys, *ARC, F.explode(F.array_distinct(F.array(*ARC))).alias(ACTIVITY))
    touched = join_lookup(placed, ends, [*keys, ACTIVITY])
    near = with_neighbours(touched, before=[ACTIVITY, POS], by=[*keys, VARIANT, *ARC], order=[POS])
    return near.where(
        (F.col(ACTIVITY) == F.col("dst")) & (F.col(f"prev_{ACTIVITY}") == F.col("src"))
    ).withColumn("src_pos", F.col(f"prev_{POS}")).select(*columns)


def arc_frequency(arcs_of_cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each arc is used over all cases, most used first."""
    return arcs_of_cases.groupBy(*keys, *ARC).agg(F.sum("reps").alias("frequency")).orderBy(*keys, F.desc("frequency"), *ARC)


def variant_arcs(
    events: DataFrame, model: DataFrame, chosen: DataFrame, mode: str = "latest", keys: Sequence[str] = (), few: bool = True
) -> DataFrame:
    """The arcs of a few chosen variants, such as `top_variants`, in order of the event they lead to."""
    return case_arcs(events, model, mode, chosen, few=few, keys=keys).orderBy(*keys, VARIANT, POS, "src")


def arcs_of_reported_cases(
    events: DataFrame, model: DataFrame, reported: DataFrame, keys: Sequence[str] = (), few: bool = True
) -> DataFrame:
    """The arcs of the two rows of `longest_shortest_case`, by `kind`."""
    reported = reported.select(*keys, "kind", TRACE)
    single = reported.select(
        *keys, F.col(TRACE).alias(VARIANT), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("n_events")
    ).distinct()
    found = case_arcs(events, model, chosen=single, few=few, keys=keys).withColumnRenamed(VARIANT, TRACE)
    return found.join(F.broadcast(reported) if few else reported, [*keys, TRACE]).select(
        *keys, "kind", TRACE, "src_pos", POS, *ARC)


def _above(arcs: DataFrame, limit: Column, keys: Sequence[str]) -> DataFrame:
    """Arcs more frequent than `limit` times the largest frequency of the slice: a window over one row per arc."""
    if keys:
        top = F.max("frequency").over(Window.partitionBy(*keys))
        return arcs.withColumn("_top", top).where(F.col("frequency") > F.col("_top") * limit).drop("_top")
    return arcs.where(F.col("frequency") > arcs.agg(F.max("frequency")).scalar() * limit)


def prune_arcs(arcs: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """The arcs whose frequency is above `threshold` times the largest one."""
    return _above(arcs, F.lit(float(threshold)), keys)


def prune_arcs_many(arcs: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """`prune_arcs` for several thresholds, told apart by the column `threshold`."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    if keys:
        return _above(arcs.withColumn("threshold", F.explode(limits)), F.col("threshold"), keys)
    top = arcs.agg(F.max("frequency")).scalar()
    return arcs.withColumn("threshold", F.explode(limits)).where(F.col("frequency") > top * F.col("threshold"))


def arc_nodes(arcs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The activities at either end of the arcs."""
    return arcs.select(*keys, F.explode(F.array(*ARC)).alias(ACTIVITY)).distinct()


def _steps(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive events of a case with the time from complete to start in between."""
    near = with_neighbours(with_names(events), after=[ACTIVITY, START], by=[*keys, TRACE]).where(~F.col("is_last"))
    return near.select(
        *keys, TRACE, F.col(ACTIVITY).alias("src"), F.col(f"next_{ACTIVITY}").alias("dst"),
        (F.col(f"next_{START}") - F.col(COMPLETE)).alias("duration"))


def arc_duration_stats(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Max, min, truncated mean and deviation of the times on each arc."""
    return _steps(events, keys).groupBy(*keys, *ARC).agg(*duration_summary("duration")).drop("_total")


def case_step_stats(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same over the steps of each case."""
    return _steps(events, keys).groupBy(*keys, TRACE).agg(*duration_summary("duration")).drop("_total")


def extreme_step_cases(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The case with the largest longest step and the one with the smallest shortest step."""
    row = F.struct(TRACE, "max", "min", "mean", "deviation")
    ends = case_step_stats(events, keys).groupBy(*keys).agg(
        F.min_by(row, F.struct(-F.col("max"), F.col(TRACE))).alias("longest"),
        F.min_by(row, F.struct("min", TRACE)).alias("shortest"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("of")) for k in ("longest", "shortest")])
    return ends.select(*keys, F.inline(kinds)).select(*keys, "kind", "of.*")
