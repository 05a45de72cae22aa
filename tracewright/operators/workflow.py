"""Report on workflows and categories of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.spec import COMPLETE, ORDER, TRACE

# Fixed values in milliseconds; a month is a twelfth of 365.25 days.
DAY, WEEK, MONTH = 86_400_000, 604_800_000, 2_629_800_000
WANTED_BINS = 30


def case_completion_extents(events: DataFrame, workflow: str, category: str) -> DataFrame:
    """Per case: smallest and largest complete time, and workflow and category of its first event."""
    return (
        events.where(F.col(TRACE).isNotNull()).groupBy(TRACE)
        .agg(F.min(COMPLETE).alias("first_complete"), F.max(COMPLETE).alias("last_complete"),
             F.min_by(F.struct(F.col(workflow).alias("workflow"), F.col(category).alias("category")),
                      F.struct(*ORDER)).alias("_of"))
        .select(TRACE, "first_complete", "last_complete", "_of.*")
    )


def workflow_executions(extents: DataFrame) -> DataFrame:
    """Number of cases per workflow."""
    return extents.groupBy("workflow").agg(F.count("*").alias("n"))


def workflow_share(extents: DataFrame) -> DataFrame:
    """Share of each workflow in all cases."""
    total = F.sum("n").over(Window.partitionBy())  # one row per workflow
    return workflow_executions(extents).select("workflow", "n", (F.col("n") / total).alias("share"))


def workflow_categories(extents: DataFrame) -> DataFrame:
    """The pairs of workflow and category that occur: read by either column."""
    return extents.select("workflow", "category").distinct()


def workflow_durations(extents: DataFrame) -> DataFrame:
    """Min, mean and max time from first to last completion per workflow."""
    span = F.col("last_complete") - F.col("first_complete")
    return extents.groupBy("workflow").agg(
        F.count("*").alias("n"), F.min(span).alias("min"), (F.sum(span.cast("decimal(38,0)")).cast("double") / F.count("*")).alias("mean"),
        F.max(span).alias("max"))


def _width(first: Column, last: Column) -> Column:
    step = F.floor((last - first) / WANTED_BINS)
    return F.when(step < DAY, DAY).when(step < WEEK, WEEK).otherwise(MONTH).cast("long")


def report_bin_width(extents: DataFrame) -> DataFrame:
    """One row: first and last end of a case, and days, weeks or months as `width` between bins."""
    ends = extents.agg(F.min("last_complete").alias("first"), F.max("last_complete").alias("last"))
    return ends.withColumn("width", _width(F.col("first"), F.col("last")))


def category_timeline(extents: DataFrame) -> DataFrame:
    """Cases of each category that end in each bin, zeros included: `category, bin, bin_start, n`.

    Bins count from the earliest end of a case.
    """
    frame = report_bin_width(extents).select(F.struct("first", "last", "width")).scalar()
    first, last, width = frame["first"], frame["last"], frame["width"]
    counted = extents.groupBy(
        "category", F.floor((F.col("last_complete") - first) / width).cast("long").alias("bin")
    ).agg(F.count("*").alias("n"))
    bins = F.sequence(F.lit(0).cast("long"), F.floor((last - first) / width).cast("long"))
    grid = extents.select("category").distinct().select("category", F.explode(bins).alias("bin"))
    return grid.join(counted, ["category", "bin"], "left").select(
        "category", "bin", (first + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def category_timeline_share(timeline: DataFrame) -> DataFrame:
    """Total of each bin and the percentage of each category in it (null in an empty bin)."""
    total = F.sum("n").over(Window.partitionBy("bin"))
    return timeline.withColumn("total", total).withColumn(
        "share", F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100))


def workflow_category_matrix(extents: DataFrame, workflows: Sequence[str] | None = None) -> DataFrame:
    """Executions of each workflow under each of its categories.

    A workflow counts in full under every category it occurs in. With `workflows` listed, they
    become columns.
    """
    pairs = workflow_categories(extents).join(workflow_executions(extents), "workflow")
    if workflows is None:
        return pairs.select("category", "workflow", "n")
    return pairs.groupBy("category").pivot("workflow", list(workflows)).agg(F.sum("n"))
