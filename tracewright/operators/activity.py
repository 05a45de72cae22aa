"""Statistics of activities. START and END events are left out unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.cleaning import drop_dummies
from tracewright.plans.ranks import medians
from tracewright.spec import ACTIVITY, COMPLETE, START, TRACE

QUARTILES = 4
QUARTILE_GAP_MS = 1  # a slice starts this long after the one before it ends


def duration_summary(value: str, weight: str | None = None) -> list[Column]:
    """Mean (truncated), max, min, deviation and total of a bigint column, and the total as a decimal (`_total`).

    With `weight` a row stands for that many, and a row of weight 0 for none. The deviation is taken around the truncated mean m, from
    sums of integers: the sum of (x - m)^2 is sum(x^2) - 2 m sum(x) + n m^2. That needs one pass and gives
    the same however rows are split over tasks. Where a term passes 38 digits, the variance in floating
    point takes its place. Sums are decimals, so that only `total` itself is null if it is beyond a bigint.
    """
    wide = "decimal(38,0)"
    counted = F.when(F.col(weight) > 0, F.col(value)) if weight else F.col(value)
    x = counted.cast("decimal(19,0)")
    w = F.when(counted.isNotNull(), F.col(weight)).cast("decimal(19,0)") if weight else None
    total = F.sum((x * w if weight else x).cast(wide))
    n = F.coalesce(F.sum(w), F.lit(0)).cast("long") if weight else F.count(value)
    truncated = F.when(n > 0, _div(total, n))
    m = truncated.cast(wide)
    square = F.try_multiply(x * x, w) if weight else x * x
    squares = F.try_add(
        F.try_subtract(F.try_sum(square), F.try_multiply(F.try_multiply(m, F.lit(2).cast(wide)), total)),
        F.try_multiply(n.cast(wide), F.try_multiply(m, m)))
    y = counted.cast("double")
    mean = total.cast("double") / n
    if weight:
        floating = F.sum(y * y * F.col(weight)) / n - mean * mean + F.pow(mean - truncated, 2)
    else:
        floating = F.var_pop(value) + F.pow(mean - truncated, 2)
    return [
        truncated.alias("mean"),
        F.max(counted).alias("max"),
        F.min(counted).alias("min"),
        F.sqrt(F.coalesce(squares.cast("double") / n, floating)).alias("deviation"),
        total.try_cast("long").alias("total"),
        total.alias("_total"),
    ]


def _div(total: Column, n: Column) -> Column:
    """Whole part of the quotient."""
    return F.call_function("div", total, n)


def _share(keys: Sequence[str]) -> Column:
    return F.col("n") / F.sum("n").over(Window.partitionBy(*keys))


def _counts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return drop_dummies(events).groupBy(*keys, ACTIVITY).agg(F.count("*").alias("n"))


def activity_frequency(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events per activity, most frequent first."""
    return _counts(events, keys).orderBy(*keys, F.desc("n"), ACTIVITY)


def activity_relative_frequency(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each activity in all events, most frequent first."""
    return _counts(events, keys).select(*keys, ACTIVITY, "n", _share(keys).alias("share")).orderBy(
        *keys, F.desc("n"), ACTIVITY)


def log_interval(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First start and last complete over all given events, START and END included."""
    return events.groupBy(*keys).agg(F.min(START).alias("first"), F.max(COMPLETE).alias("last"))


def log_span(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last complete minus first start."""
    return log_interval(events, keys).withColumn("span", F.col("last") - F.col("first"))


def _quarter_ends(first: Column, last: Column) -> list[Column]:
    step = F.floor((last - first) / QUARTILES).cast("long")
    return [first + step * q for q in range(1, QUARTILES)] + [last]


def quartile_intervals(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Four slices of equal time: `quartile, first, last`, ends included."""
    ends = _quarter_ends(F.col("first"), F.col("last"))
    slices = F.array(*[
        F.struct(F.lit(q).alias("quartile"),
                 (ends[q - 2] + QUARTILE_GAP_MS if q > 1 else F.col("first")).alias("first"),
                 ends[q - 1].alias("last"))
        for q in range(1, QUARTILES + 1)])
    return log_interval(events, keys).select(*keys, F.inline(slices))


def activity_frequency_by_quartile(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each activity in the events that start within each slice of the log's time."""
    extent = log_interval(events, keys)
    if keys:
        # one row per value of the keys; adaptive execution picks the join by its actual size
        placed = events.join(extent, list(keys))
        first, last = F.col("first"), F.col("last")
    else:
        placed = events
        found = extent.select(F.struct("first", "last")).scalar()
        first, last = found["first"], found["last"]
    ends = _quarter_ends(first, last)
    # slices touch without overlap at millisecond resolution, so the first end not passed decides
    quartile = F.coalesce(*[F.when(F.col(START) <= end, q) for q, end in enumerate(ends, start=1)])
    counted = (
        drop_dummies(placed)
        .withColumn("quartile", quartile)
        .where(F.col("quartile").isNotNull())
        .groupBy(*keys, "quartile", ACTIVITY)
        .agg(F.count("*").alias("n"))
    )
    return counted.select(*keys, "quartile", ACTIVITY, "n", _share([*keys, "quartile"]).alias("share"))


def _with_duration(events: DataFrame) -> DataFrame:
    return drop_dummies(events).withColumn("duration", F.col(COMPLETE) - F.col(START))


def activity_averages(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The duration statistics that one pass gives: all of `activity_durations` but the median."""
    return _with_duration(events).groupBy(*keys, ACTIVITY).agg(*duration_summary("duration")).drop("_total")


def activity_durations(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, max, min, deviation, total and median duration per activity, longest mean first.

    Events are counted once per activity and duration; all numbers come from that table, the median
    from the running counts of its high digits.
    """
    by = [*keys, ACTIVITY]
    # unknown durations are rows of no weight: a filter on them would make two tables of it
    value = F.coalesce("duration", F.lit(0).cast("long")).alias("_value")
    counts = _with_duration(events).groupBy(*by, value).agg(F.count("duration").alias("_known"))
    averages = counts.groupBy(*by).agg(*duration_summary("_value", "_known")).drop("_total")
    middle = medians(counts.where("_known > 0"), by, "_value", "_known").withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return averages.join(middle, same, "left").select(*averages.columns, "median").orderBy(
        *keys, F.desc("mean"), ACTIVITY)


def longest_shortest_activity(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The activities of largest and smallest total duration, ties by name."""
    row = F.struct(ACTIVITY, "total", "deviation")
    sums = _with_duration(events).groupBy(*keys, ACTIVITY).agg(*duration_summary("duration"))
    ends = sums.groupBy(*keys).agg(
        F.min_by(row, F.struct(-F.col("_total"), F.col(ACTIVITY))).alias("longest"),
        F.min_by(row, F.struct("_total", ACTIVITY)).alias("shortest"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("of")) for k in ("longest", "shortest")])
    return ends.select(*keys, F.inline(kinds)).select(*keys, "kind", "of.*")


def cases_of_activity(events: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """The cases that contain an activity."""
    return events.where(F.col(ACTIVITY) == name).select(*keys, TRACE).distinct()


def activity_duration_share(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean duration of each activity as a percentage of the sum of all means."""
    share = F.col("mean") / F.sum("mean").over(Window.partitionBy(*keys)) * 100
    return activity_averages(events, keys).select(*keys, ACTIVITY, "mean", share.alias("share"))
