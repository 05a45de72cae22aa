"""Buckets for colouring: a value column of an activity or arc table in a few classes.

`keys` are extra columns, such as `branch_id`: each slice has buckets of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.ranks import values_at_ranks

BUCKETS = 4


def _kept(df: DataFrame, kept: DataFrame | None) -> DataFrame:
    return df if kept is None else df.join(kept, kept.columns, "left_semi")


def _beside(df: DataFrame, per_slice: DataFrame, name: str, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The one row of a slice next to its rows: a column of that name, or a scalar where there are no keys."""
    row = F.struct(*[c for c in per_slice.columns if c not in keys])
    if not keys:
        return df, per_slice.select(row).scalar()
    return df.join(per_slice.select(*keys, row.alias(name)), list(keys), "left"), F.col(name)


def bucket_equal_width(
    df: DataFrame, value: str, buckets: int = BUCKETS, whole_steps: bool = False, kept: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Bucket 0 to `buckets - 1` by steps of `max / buckets`; lower edges inclusive, the top open.

    `whole_steps` cuts the step down to an integer. The maximum is that of all rows, even if only
    those in `kept` (rows of the model, say) are bucketed.
    """
    rows, of = _beside(df, df.groupBy(*keys).agg(F.max(value).alias("top")), "_of", keys)
    step = of["top"] / buckets
    if whole_steps:
        step = F.floor(step)
    bucket = F.coalesce(
        *[F.when(F.col(value) < step * (i + 1), i) for i in range(buckets - 1)], F.lit(buckets - 1))
    return _kept(rows.withColumn("bucket", bucket).select(*df.columns, "bucket"), kept)


def bucket_equal_count(df: DataFrame, value: str, kept: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Four buckets 0 to 3 of about as many different values each; equal values share a bucket.

    The distinct values, largest first, are cut in half and each half in half again, an odd one
    going to the lower part.
    """
    df = _kept(df, kept)
    n = F.col("n")
    upper = F.floor(n / 2)
    cuts = {"_c3": F.floor(upper / 2), "_c2": upper, "_c1": upper + F.floor((n - upper) / 2)}
    # the smallest value of the best c distinct ones has rank n - c from below
    bounds = values_at_ranks(df.select(*keys, value).distinct(), keys, value, {name: n - c for name, c in cuts.items()})
    rows, bound = _beside(df, bounds.select(*keys, *cuts), "_of", keys)
    bucket = F.coalesce(
        *[F.when(F.col(value) >= bound[name], b) for name, b in (("_c3", 3), ("_c2", 2), ("_c1", 1))], F.lit(0))
    return rows.withColumn("bucket", bucket).select(*df.columns, "bucket")


def bounds_equal_width(df: DataFrame, value: str, buckets: int = BUCKETS, keys: Sequence[str] = ()) -> DataFrame:
    """Limits of the equal-width buckets: `bucket, low, high`."""
    step = F.col("_top") / buckets
    rows = F.array(*[
        F.struct(F.lit(i).alias("bucket"), (step * i).alias("low"), (step * (i + 1)).alias("high"))
        for i in range(buckets)])
    return df.groupBy(*keys).agg(F.max(value).alias("_top")).select(*keys, F.inline(rows))


def bounds_equal_count(bucketed: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Limits of the buckets that hold rows: from the top of the one below to their own top."""
    ends = bucketed.groupBy(*keys, "bucket").agg(F.min(value).alias("_min"), F.max(value).alias("high"))
    below = F.lag("high").over(Window.partitionBy(*keys).orderBy("bucket"))  # at most BUCKETS rows of a slice
    return ends.select(*keys, "bucket", F.coalesce(below, F.col("_min")).alias("low"), "high")
