"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.storage import store

DIGIT = 20  # bits of the low digit: at most 2**20 different values share a high digit


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], weight: str | None = None
) -> DataFrame:
    """The values of a bigint column at given 0-based ranks of each group, one column per rank.

    A rank is an expression over `n`, the number of rows of the group; ranks outside it give null.
    Rows are first counted per distinct value, then per high digit. The running count over the high
    digits says in which one each rank falls, and only the values of that digit are looked at
    again. A window therefore sees high digits or the values of a single digit, never a whole group.
    Null values do not count; a null key is a group like any other. With `weight` a row stands for that
    many, and there is one row for each value of a group.
    """
    keys = list(keys)
    if weight:
        counts = df.select(*keys, value, F.col(weight).alias("_n"))
    else:
        counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_top", F.shiftright(F.col(value), DIGIT))
    # the join below asks for the same; said here, both of its sides share one scan and shuffle
    for column in [value, "_top"]:
        counts = counts.where(F.col(column).isNotNull())

    def cumulative(histogram: DataFrame, group: Sequence[str], step: str) -> DataFrame:
        upto = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        return histogram.withColumn("_to", F.sum("_n").over(upto)).withColumn(
            "_from", F.col("_to") - F.col("_n"))

    digits = counts.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*keys)
    digits = cumulative(digits, keys, "_top").withColumn("n", F.sum("_n").over(whole))
    wanted = digits.select(
        *keys, "_top", "_from", "_to",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), rank.cast("long").alias("at"))
            for name, rank in ranks.items()
        ])).alias("_rank"),
    ).where((F.col("_rank.at") >= F.col("_from")) & (F.col("_rank.at") < F.col("_to")))
    targets = wanted.groupBy(*keys, "_top").agg(
        F.collect_list(F.struct("_rank.name", (F.col("_rank.at") - F.col("_from")).alias("at"))).alias("_ranks"))

    targets = targets.withColumnsRenamed({c: f"_of_{c}" for c in [*keys, "_top"]})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys] + [F.col("_top") == F.col("_of__top")]
    near = cumulative(counts.join(targets, same), [*keys, "_top"], value)
    hits = near.select(*keys, value, "_from", "_to", F.explode("_ranks").alias("_rank")).where(
        (F.col("_rank.at") >= F.col("_from")) & (F.col("_rank.at") < F.col("_to")))
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rank.name") == name, F.col(value))).alias(name) for name in ranks])


def medians(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Median per group as `median`; an even count gives the truncated mean of the middle two."""
    half = F.floor(F.col("n") / 2)
    middle = values_at_ranks(df, keys, value, {
        "_upper": half,
        "_lower": F.when(F.col("n") % 2 == 0, half - 1).otherwise(half),
    }, weight)
    return middle.select(*keys, F.expr("(cast(_lower as decimal(20,0)) + cast(_upper as decimal(20,0))) div 2").alias("median"))


def numbered(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each group from 1 in the given order, without a group in one task.

    Rows are range-partitioned by group and order and written once; numbers inside a part are those of a
    window, and what lies before it comes from a table with a row for each group and part. Equal rows
    get numbers in no order of their own.
    """
    parts = store(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_of_part"), before.alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_part") == F.col("_of_part")]
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    placed = parts.withColumn(name, F.row_number().over(inside)).join(sizes, same)
    return placed.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)
