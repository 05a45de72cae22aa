"""Ways around hot keys: slicing very large cases, and joins with a table of checked size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.storage import store
from tracewright.spec import ORDER, PART, SEQ, START, TRACE

HOT_CASE_EVENTS = 1_000_000  # a case above this is sliced, and a slice holds about as many events
HOT_KEY_ROWS = 1_000_000  # a key of more rows is joined apart
BROADCAST_ROWS = 200_000
SALTS = 64
_WHOLE = {"slices": False}  # metadata of a slice column that holds no slices


def split_hot_cases(log: DataFrame, min_events: int = HOT_CASE_EVENTS) -> DataFrame:
    """Add `case_part`, a slice number in event order for the events of very large cases, null for all others.

    Windows over a case then run on (case, slice), so one case never has to fit in one task;
    `with_neighbours` and `with_positions` put the slices back together. Slices only steer where the
    work runs, never what it yields. Cases are counted exactly, events without a case id as one of them.
    The events of large cases are range-partitioned by case and order, a partition for each `min_events`
    of them, and written once to shared storage: the partition is the slice. All other events are read
    from the log as it is, and keep their filters. The column is there whatever the size of the log.
    """
    case = F.coalesce(F.concat(F.lit("="), TRACE), F.lit("")).alias("_case")
    sizes = log.groupBy(case).agg(F.count("*").alias("_events")).where(F.col("_events") > min_events)
    sizes = store(sizes, "hot-cases")
    n_cases, n_events = sizes.agg(F.count("*"), F.sum("_events")).first()
    if not n_cases:
        return log.withColumn(PART, F.lit(None).cast("int")).withMetadata(PART, _WHOLE)
    keyed, hot = log.select("*", case), sizes.select("_case")
    parts = join_lookup(keyed, hot, ["_case"], "left_semi", rows=n_cases).drop("_case").repartitionByRange(
        math.ceil(n_events / min_events), TRACE, *ORDER).withColumn(PART, F.spark_partition_id())
    others = join_lookup(keyed, hot, ["_case"], "left_anti", rows=n_cases).drop("_case")
    return others.withColumn(PART, F.lit(None).cast("int")).unionByName(store(parts, "sliced-cases"))


def sliced(df: DataFrame) -> list[str]:
    """The extra grouping column of a log with sliced cases."""
    return [PART] if PART in df.columns and df.schema[PART].metadata != _WHOLE else []


def _beside(df: DataFrame, per_slice: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join with one row per slice; events without a case id are a case here too."""
    own = per_slice.withColumnsRenamed({c: f"_of_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return df.join(own, same, "left").drop(*[f"_of_{c}" for c in group])


def with_neighbours(
    df: DataFrame,
    before: Sequence[str] = (),
    after: Sequence[str] = (),
    by: Sequence[str] = (TRACE,),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add `prev_<c>` / `next_<c>` of the neighbouring rows, and `is_first` / `is_last`.

    The flags only appear for a side that is asked for.
    """
    group = [*by, *sliced(df)]
    window = Window.partitionBy(*group).orderBy(*order)
    sides = []
    if before:
        sides.append(("_before", list(before), F.lag, F.max_by, "prev", "is_first"))
    if after:
        sides.append(("_after", list(after), F.lead, F.min_by, "next", "is_last"))
    out = df.select("*", *[shift(F.struct(*cols)).over(window).alias(name)
                           for name, cols, shift, _, _, _ in sides])
    if sliced(df):
        # at most one row per (case, slice): the rows that meet at the borders
        edges = df.where(F.col(PART).isNotNull()).groupBy(*group).agg(
            *[pick(F.struct(*cols), F.struct(*order)).alias(name) for name, cols, _, pick, _, _ in sides])
        along = Window.partitionBy(*by).orderBy(PART)
        edges = edges.select(*group, *[shift(name).over(along).alias("_edge" + name)
                                       for name, _, shift, _, _, _ in sides])
        out = _beside(out, edges, group)
        for name, *_ in sides:
            out = out.withColumn(name, F.coalesce(name, "_edge" + name)).drop("_edge" + name)
    for name, cols, _, _, prefix, flag in sides:
        out = out.select("*", *[F.col(name)[c].alias(f"{prefix}_{c}") for c in cols],
                         F.col(name).isNull().alias(flag)).drop(name)
    return out


def with_latest(
    df: DataFrame, values: Sequence[Column], name: str, by: Sequence[str] = (TRACE,), order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add an array: for each of the values the last one that is not null in the rows before, in order.

    All of them come from one window, so there is one shuffle however many there are. Values may not be arrays.
    """
    group = [*by, *sliced(df)]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", F.array(*[F.last(v, ignorenulls=True).over(before) for v in values]).alias(name))
    if sliced(df):
        at = F.struct(*order)
        ends = df.where(F.col(PART).isNotNull()).groupBy(*group).agg(
            *[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_{i}") for i, v in enumerate(values)])
        earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*group, F.array(*[
            F.last(f"_{i}", ignorenulls=True).over(earlier) for i in range(len(values))]).alias("_edge"))
        out = _beside(out, ends, group)
        both = F.zip_with(name, "_edge", lambda own, edge: F.coalesce(own, edge))
        out = out.withColumn(name, F.when(F.col("_edge").isNull(), F.col(name)).otherwise(both)).drop("_edge")
    return out


def with_positions(
    df: DataFrame, name: str, by: Sequence[str] = (TRACE,), order: Sequence[str] = ORDER
) -> DataFrame:
    """Number the rows of a group from 1 in the given order."""
    group = [*by, *sliced(df)]
    window = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window).cast("long"))
    if sliced(df):
        counts = df.where(F.col(PART).isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"))
        earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
        out = _beside(out, offsets, group).withColumn(
            name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset")
    return out


def join_lookup(
    big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
    limit: int = BROADCAST_ROWS, rows: int | None = None,
) -> DataFrame:
    """Join with a table that is usually tiny, on a key that may be hot in `big`: inner, left_semi or left_anti.

    The lookup is counted first unless its number of `rows` is known, so it should be cheap to
    compute or materialized. Up to `limit` rows it is broadcast; beyond that it is repeated once per
    salt and the big side spread over the salts.
    """
    if (lookup.count() if rows is None else rows) <= limit:
        return big.join(F.broadcast(lookup), list(on), how)
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def join_dimension(
    facts: DataFrame, dimension: DataFrame, key: str, limit: int = BROADCAST_ROWS, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Inner join with a table of unique keys of any size, when some keys may be hot in the facts.

    A dimension of up to `limit` rows is broadcast. Of a larger one, the rows of keys with more than
    `hot_rows` facts are looked up apart; the keys are counted exactly, so there are at most as many
    as facts divided by that. All other keys go through an ordinary join that no single key dominates any more.
    """
    if dimension.count() <= limit:
        return facts.join(F.broadcast(dimension), key)
    hot = store(facts.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(key), "hot-keys")
    n = hot.count()
    if not n:
        return facts.join(dimension, key)
    looked_up = join_lookup(facts, join_lookup(dimension, hot, [key], "left_semi", rows=n), [key], limit=limit, rows=n)
    others = join_lookup(facts, hot, [key], "left_anti", rows=n).join(dimension, key)
    return looked_up.unionByName(others)
