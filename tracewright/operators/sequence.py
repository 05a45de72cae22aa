"""Events in the order of their case.

All windows here run on the same grouping and order, so that a chain of these operators needs one
shuffle and one sort. `keys` are extra grouping columns, such as `branch_id`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.plans.skew import with_neighbours, with_positions
from tracewright.spec import (
    ACTIVITY, COMPLETE, DUMMY_MS, EMPTY, END_TASK, PART, POS, SEGMENT, SEGMENT_EVENTS, SEQ, START, START_TASK, TRACE,
)


def of_cases(events: DataFrame) -> DataFrame:
    """Events without a case id are in no case: they count as activities, but are in no sequence and no arc.

    Said in every operator on cases, since a join on the case says it too: the same filter everywhere lets
    all parts of a query share one shuffle.
    """
    return events.where(F.col(TRACE).isNotNull())


def with_names(events: DataFrame) -> DataFrame:
    """Events of cases as arcs see them: an activity that is missing goes by EMPTY."""
    return of_cases(events).withColumn(ACTIVITY, F.coalesce(ACTIVITY, F.lit(EMPTY)))


def sequence(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number the events of each case by start time as `pos`, from 1."""
    return with_positions(events, POS, by=[*keys, TRACE])


def collapse_runs(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Make one event of consecutive equal activities.

    It starts with the first and completes with the last of the run, which need not be the latest
    completion. Other attributes are those of the first.
    """
    by = [*keys, TRACE]
    near = with_neighbours(events, before=[ACTIVITY], after=[ACTIVITY], by=by)
    opens = F.col("is_first") | ~F.col(f"prev_{ACTIVITY}").eqNullSafe(F.col(ACTIVITY))
    closes = F.col("is_last") | ~F.col(f"next_{ACTIVITY}").eqNullSafe(F.col(ACTIVITY))
    borders = near.withColumns({"_opens": opens, "_closes": closes}).where("_opens or _closes").select(
        *events.columns, "_opens", "_closes")
    # only borders are left: a run of several events is its first row, then its last
    return (
        with_neighbours(borders, after=[COMPLETE], by=by)
        .where("_opens")
        .withColumn(COMPLETE, F.when(F.col("_closes"), F.col(COMPLETE)).otherwise(F.col(f"next_{COMPLETE}")))
        .select(*events.columns)
    )


def artificial_starts(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Let each event start when the one before it completed; the first keeps its start.

    For logs that know one time per event.
    """
    near = with_neighbours(events, before=[COMPLETE], by=[*keys, TRACE])
    start = F.when(F.col("is_first"), F.col(START)).otherwise(F.col(f"prev_{COMPLETE}"))
    return near.withColumn(START, start).select(*events.columns)


def add_dummies(events: DataFrame, keys: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Put a START event before the first and an END event after the last event of each case.

    START ends where the first event starts, END starts where the last event (in start order)
    completes; both last a second. If the events carry `pos`, they get the positions around. Other
    attributes are empty but for those in `keep`, which hold for the whole case.
    """
    by = [*keys, TRACE]
    near = with_neighbours(events, before=[SEQ], after=[SEQ], by=by)
    # only a marker is exploded: the case column stays what the rows are partitioned by
    marker = F.array_compact(F.array(
        F.when(F.col("is_first"), "start"), F.lit("own"), F.when(F.col("is_last"), "end")))
    rows = near.withColumn("_row", F.explode(marker))
    kept = {*by, *keep, PART}

    def value(column: str) -> Column:
        own = F.col(column)
        start, end = {
            ACTIVITY: (F.lit(START_TASK), F.lit(END_TASK)),
            START: (own - DUMMY_MS, F.col(COMPLETE)),
            COMPLETE: (F.col(START), own + DUMMY_MS),
            SEQ: (own - 1, own + 1),
            POS: (own - 1, own + 1),
        }.get(column, (F.lit(None), F.lit(None)))
        return F.when(F.col("_row") == "start", start).when(F.col("_row") == "end", end).otherwise(own)

    return rows.select(*[F.col(c) if c in kept else value(c).alias(c) for c in events.columns])


def padded_sequence(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The numbered events with START at 0 and END after the last: what models are found in."""
    return add_dummies(sequence(events, keys), keys)


def prepare(
    events: DataFrame, keys: Sequence[str] = (), group: bool = False, instant: bool = False,
    dummies: bool = True,
) -> DataFrame:
    """The event table that the activity statistics run on: runs, then made-up starts, then dummies."""
    if group:
        events = collapse_runs(events, keys)
    if instant:
        events = artificial_starts(events, keys)
    return add_dummies(events, keys) if dummies else events


def extent_columns() -> list[Column]:
    """Aggregates over a case: start of the first, and complete of the last event in start order."""
    return [F.min(START).alias("first_time"), F.max(F.struct(START, SEQ, COMPLETE))[COMPLETE].alias("last_time")]


def case_extents_by_order(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time per case. Events without a case id are in no case.

    Other events are combined before the shuffle, so a very large case costs no more than others.
    """
    return of_cases(events).groupBy(*keys, TRACE).agg(*extent_columns())


def traces(
    events: DataFrame, keys: Sequence[str] = (), instant: bool = False, dummies: bool = True,
    segment_events: int = SEGMENT_EVENTS,
) -> DataFrame:
    """One row per case with its activities and their times as arrays.

    A case of more than `segment_events` events takes several rows, numbered by `segment`, each with
    the arrays and the first and last time of its own stretch of positions: no row grows with the
    case. First and last time leave START and END out.
    """
    placed = sequence(of_cases(events), keys)
    if instant:
        placed = artificial_starts(placed, keys)
    if dummies:
        placed = add_dummies(placed, keys)
    rows = placed.withColumn(SEGMENT, segment_of(segment_events)).groupBy(*keys, TRACE, SEGMENT).agg(
        F.sort_array(F.collect_list(F.struct(POS, ACTIVITY, START, COMPLETE))).alias("_items"))
    real = F.filter("_items", lambda e: ~e[ACTIVITY].isin(START_TASK, END_TASK))
    return rows.select(
        *keys, TRACE, SEGMENT,
        F.col(f"_items.{ACTIVITY}").alias("activities"),
        F.transform("_items", lambda e: F.struct(e[START].alias("start"), e[COMPLETE].alias("complete")))
        .alias("activities_time"),
        F.get(real, F.lit(0))[START].alias("first_time"),
        F.element_at(real, -1)[COMPLETE].alias("last_time"),
    )


def segment_of(segment_events: int) -> Column:
    """The stretch of positions an event belongs to: START goes with the first, END with the last."""
    inner = F.when(F.col(ACTIVITY) == START_TASK, F.lit(1)).when(
        F.col(ACTIVITY) == END_TASK, F.col(POS) - 1).otherwise(F.col(POS))
    return F.floor((inner - 1) / segment_events).cast("long")


def case_count(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of cases as `n_cases`. Events without a case id are in no case, here as in variants."""
    cases = of_cases(events).select(*keys, TRACE).distinct()
    return (cases.groupBy(*keys) if keys else cases).agg(F.count("*").alias("n_cases"))
