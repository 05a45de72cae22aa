"""Statistics of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.sequence import case_extents_by_order, sequence, traces
from tracewright.plans.ranks import medians, values_at_ranks
from tracewright.spec import ACTIVITY, COMPLETE, POS, SEGMENT, START, TRACE

FIVE_NUMBERS_ABOVE = 4  # with this many cases or fewer there is no five-number summary


def case_durations(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Complete of the last event (in start order) minus start of the first, per case."""
    return case_extents_by_order(events, keys).withColumn(
        "duration", F.col("last_time") - F.col("first_time"))


def case_activity_times(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Start and complete of every event of a case, in order, one per row."""
    return sequence(events, keys).select(*keys, TRACE, POS, START, COMPLETE)


def case_first_time(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First start per case."""
    return case_durations(events, keys).select(*keys, TRACE, "first_time")


def case_last_time(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Complete of the last event per case."""
    return case_durations(events, keys).select(*keys, TRACE, "last_time")


def case_extents(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time of each case, earliest first."""
    return case_durations(events, keys).select(*keys, TRACE, "first_time", "last_time").orderBy(
        *keys, "first_time", TRACE)


def longest_shortest_case(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The cases of largest and smallest duration, ties by case id: two rows per value of the keys."""
    row = F.struct(TRACE, "duration")
    ends = case_durations(events, keys).groupBy(*keys).agg(
        F.min_by(row, F.struct(-F.col("duration"), F.col(TRACE))).alias("longest"),
        F.min_by(row, F.struct("duration", TRACE)).alias("shortest"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("of")) for k in ("longest", "shortest")])
    return ends.select(*keys, F.inline(kinds)).select(*keys, "kind", "of.*")


def case_activities(events: DataFrame, chosen: DataFrame, keys: Sequence[str] = (), few: bool = True) -> DataFrame:
    """Activities of a few chosen cases as arrays, with the columns of `chosen` added.

    `chosen` has one row per report line, such as the two rows of `longest_shortest_case`, which are
    broadcast if `few` says that they are a handful. Only the events of those cases are put in order.
    """
    by = [*keys, TRACE]
    hint = F.broadcast if few else (lambda rows: rows)
    own = events.join(hint(chosen.select(*by).distinct()), by, "left_semi")
    return traces(own, keys).select(*by, SEGMENT, "activities").join(hint(chosen), by)


def duration_five_numbers(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Min, quartiles and max of the case durations by the rank rule `floor(q * n)`, counted from 0.

    Gives no row for FIVE_NUMBERS_ABOVE cases or fewer.
    """
    n = F.col("n")
    enough = n > FIVE_NUMBERS_ABOVE
    names = {
        "min": F.lit(0), "q1": F.floor(n * 0.25), "q2": F.floor(n * 0.5), "q3": F.floor(n * 0.75), "max": n - 1,
    }
    found = values_at_ranks(case_durations(events, keys), keys, "duration",
                            {name: F.when(enough, at) for name, at in names.items()})
    rows = F.array(*[F.struct(F.lit(name).alias("rank_name"), F.col(name).alias("duration")) for name in names])
    return found.select(*keys, F.inline(rows)).where(F.col("duration").isNotNull())


def median_case_duration(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the case durations; for an even count the truncated mean of the middle two."""
    return medians(case_durations(events, keys), keys, "duration")


def case_timeline(events: DataFrame, n: int = 18) -> DataFrame:
    """Complete times of the first n cases by id, one row per event; `line` numbers the cases."""
    first = events.select(TRACE).distinct().orderBy(TRACE).limit(n)
    lines = first.withColumn("line", F.row_number().over(Window.orderBy(TRACE)))  # n rows
    return sequence(events.join(F.broadcast(lines), TRACE)).select(
        "line", TRACE, POS, ACTIVITY, F.col(COMPLETE).alias("at"))
