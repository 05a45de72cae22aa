"""Variants: the different activity sequences of a log.

Two cases are of the same variant when their fingerprints agree: the number of events and two
independent 64-bit hashes over all (position, activity) pairs, combined by exclusive or. Such a
fingerprint is built up before the shuffle and never needs a whole case in one place. A variant
goes by the smallest case id among its cases, and its sequence is read from that case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.activity import duration_summary
from tracewright.operators.sequence import add_dummies, extent_columns, of_cases, segment_of, sequence
from tracewright.plans.skew import BROADCAST_ROWS, SALTS, sliced
from tracewright.spec import ACTIVITY, POS, SEGMENT, SEGMENT_EVENTS, TRACE

PRINT = ("n_events", "_hash_1", "_hash_2")
HOT_VARIANT_CASES = 1_000_000
VARIANT = "variant_id"


def fingerprints(events: DataFrame, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Per case: the fingerprint of its sequence, and further aggregates if asked for."""
    return sequence(of_cases(events), keys).groupBy(*keys, TRACE).agg(
        F.count("*").alias(PRINT[0]),
        *[F.bit_xor(F.xxhash64(F.lit(salt), POS, ACTIVITY)).alias(name)
          for salt, name in enumerate(PRINT[1:], start=1)],
        *extra,
    )


def _counted(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    return prints.groupBy(*keys, *PRINT).agg(F.min(TRACE).alias(VARIANT), F.count("*").alias("n"))


def variants(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`variant_id`, number of events, number of cases `n`: one row per distinct sequence."""
    return _counted(fingerprints(events, keys), keys).select(*keys, VARIANT, "n_events", "n")


def variant_cases(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`variant_id, trace`: the cases of each variant, one per row.

    Variants of very many cases (at most cases / HOT_VARIANT_CASES of them) are looked up by
    broadcast, the others by an ordinary join that they can no longer unbalance.
    """
    prints = fingerprints(events, keys)
    counted = _counted(prints, keys)
    on = [*keys, *PRINT]
    hot = counted.where(F.col("n") > HOT_VARIANT_CASES).select(*on, VARIANT)
    cold = counted.where(F.col("n") <= HOT_VARIANT_CASES).select(*on, VARIANT)
    return (
        prints.join(F.broadcast(hot), on)
        .unionByName(prints.join(F.broadcast(hot), on, "left_anti").join(cold, on))
        .select(*keys, VARIANT, TRACE)
    )


def variant_events(
    events: DataFrame, chosen: DataFrame, keys: Sequence[str] = (), dummies: bool = False,
    few: bool = False, segment_events: int = SEGMENT_EVENTS,
) -> DataFrame:
    """The numbered events of the cases that the chosen variants are read from.

    `chosen` is what `variants` yields, or part of it. Only events of those cases are put in order;
    the join is on the column that the windows are partitioned by. If very large cases are sliced,
    matching goes by stretch of positions, so that such a case is spread over many tasks. `few` says
    that `chosen` was limited to a handful of rows, which are then broadcast.
    """
    wanted = chosen.select(*keys, F.col(VARIANT).alias(TRACE), F.col("n").alias("reps"), "n_events")
    by_case = few or not sliced(events)
    events = of_cases(events)
    if by_case:
        cases = wanted.drop("n_events")
        events = events.join(F.broadcast(cases) if few else cases, [*keys, TRACE])
    placed = sequence(events, keys)
    if dummies:
        placed = add_dummies(placed, keys, keep=["reps"])
    placed = placed.withColumn(SEGMENT, segment_of(segment_events))
    if not by_case:
        last = F.floor((F.col("n_events") - 1) / segment_events).cast("long")
        stretches = wanted.withColumn(SEGMENT, F.explode(F.sequence(F.lit(0).cast("long"), last)))
        placed = placed.join(stretches, [*keys, TRACE, SEGMENT])
    return placed.select(*keys, F.col(TRACE).alias(VARIANT), "reps", SEGMENT, POS, ACTIVITY, *sliced(placed))


def variant_sequences(
    events: DataFrame, chosen: DataFrame, keys: Sequence[str] = (), dummies: bool = False,
    few: bool = False, segment_events: int = SEGMENT_EVENTS,
) -> DataFrame:
    """The activities of the chosen variants as arrays, in rows of at most `segment_events`.

    Further columns are the `segment` and the number of cases `n`.
    """
    return (
        variant_events(events, chosen, keys, dummies, few, segment_events)
        .groupBy(*keys, VARIANT, SEGMENT, F.col("reps").alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct(POS, ACTIVITY))).alias("_items"))
        .select(*keys, VARIANT, SEGMENT, F.col(f"_items.{ACTIVITY}").alias("activities"), "n")
    )


def _top(counted: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k rows of most cases, of each slice: first of each of SALTS parts of it, then of those few."""
    order = [F.desc("n"), F.col(VARIANT)]
    if not keys:
        return counted.orderBy(*order).limit(k)
    part = F.pmod(F.xxhash64(VARIANT), F.lit(SALTS)).alias("_part")
    first = counted.select("*", part).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_rank") <= k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= k).select(*counted.columns)


def top_variants(events: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The k variants of most cases, ties by `variant_id`.

    `variants` only carries counts, so the k rows are found without moving a single sequence.
    """
    return _top(variants(events, keys), k, keys)


def _few(k: int, keys: Sequence[str]) -> bool:
    """Whether the k first variants can be broadcast."""
    return not keys and k <= BROADCAST_ROWS


def _with_total(counted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The counted variants, with the number of cases of their slice."""
    if not keys:
        return counted, counted.agg(F.sum("n")).scalar()
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counted.join(totals, list(keys)), F.col("_total")


def variant_frequency(events: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The k most frequent variants with their cases counted and START and END around the activities."""
    return variant_sequences(events, top_variants(events, k, keys), keys, dummies=True, few=_few(k, keys)).orderBy(
        *keys, F.desc("n"), VARIANT, SEGMENT)


def variant_relative_frequency(events: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The k most frequent variants with their share of the cases."""
    counted, total = _with_total(variants(events, keys), keys)
    chosen = _top(counted, k, keys)
    shares = chosen.select(*keys, VARIANT, (F.col("n") / total).alias("share"))
    few = _few(k, keys)
    found = variant_sequences(events, chosen.select(*keys, VARIANT, "n_events", "n"), keys, few=few)
    return found.join(F.broadcast(shares) if few else shares, [*keys, VARIANT]).select(*found.columns, "share").orderBy(
        *keys, F.desc("n"), VARIANT, SEGMENT)


def variant_frequency_with_cases(events: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The k most frequent variants with each of their cases, one per row."""
    prints = fingerprints(events, keys)
    top = _top(_counted(prints, keys), k, keys)
    return prints.join(F.broadcast(top) if _few(k, keys) else top, [*keys, *PRINT]).select(*keys, VARIANT, "n", TRACE)


def variant_compliance(events: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """For each top variant: percentage of cases, cases that comply and cases that do not."""
    counted, total = _with_total(variants(events, keys), keys)
    return _top(counted, k, keys).select(
        *keys, VARIANT,
        F.round(F.col("n") / total * 100, 2).alias("percent"),
        F.col("n").alias("compliant"),
        (total - F.col("n")).alias("not_compliant"),
    )


def variant_durations(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per variant: max, min, truncated mean, deviation around it, and total of the case durations."""
    timed = fingerprints(events, keys, extent_columns()).withColumn(
        "duration", F.col("last_time") - F.col("first_time"))
    return (
        timed.groupBy(*keys, *PRINT)
        .agg(F.min(TRACE).alias(VARIANT), F.count("*").alias("n"), *duration_summary("duration"))
        .select(*keys, VARIANT, "n", "mean", "max", "min", "deviation", "total")
    )
