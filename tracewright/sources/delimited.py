"""Logs as delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import strip_accents
from tracewright.operators.cleaning import fill_empty
from tracewright.operators.cleaning import fix_case_dots as zero_dots
from tracewright.spec import ACTIVITY, COMPLETE, START, TRACE

# Heading and time pattern of an exported log.
EXPORT_COLUMNS = {
    TRACE: "CaseIdentifier", ACTIVITY: "TaskIdentifier", START: "InitialTime", COMPLETE: "CompleteTime",
}
EXPORT_PATTERN = "yyyy MM dd HH:mm:ss"


def _read(spark: SparkSession, path: str) -> DataFrame:
    # every file carries the header; all columns are text, so no pass over the data for a schema.
    # A file whose header has another order or other names ends the job instead of swapping columns
    return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, escape='"', multiLine=False)


def read_csv_log(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, fix_case_dots: bool = False
) -> DataFrame:
    """The chosen columns as clean text: no quotes or accents, `-` for an empty cell, no empty rows."""
    raw = _read(spark, path)
    first = raw.columns[0]
    kept = [c for c in raw.columns if columns is None or c in columns]
    log = raw.na.drop("all").select(
        *[strip_accents(F.translate(F.col(f"`{c}`"), '"', "")).alias(c) for c in kept])
    log = fill_empty(log)
    return zero_dots(log, first) if fix_case_dots and first in kept else log


def read_typed_log(spark: SparkSession, path: str, fix_case_dots: bool = False) -> DataFrame:
    """All columns, with the two standard time columns already in epoch milliseconds."""
    raw = _read(spark, path)
    log = raw.na.drop("all").select(
        *[(F.col(f"`{c}`").cast("long") if c in (START, COMPLETE)
           else F.translate(F.col(f"`{c}`"), '"', "")).alias(c) for c in raw.columns])
    return zero_dots(log, log.columns[0]) if fix_case_dots else log


def export_csv(events: DataFrame, path: str, times: bool = True) -> None:
    """Write case and task, and both times unless told not to, as CSV part files from the executors."""
    columns = {c: n for c, n in EXPORT_COLUMNS.items() if times or c in (TRACE, ACTIVITY)}
    events.select(
        *[(F.date_format(F.timestamp_millis(c), EXPORT_PATTERN) if c in (START, COMPLETE) else F.col(c))
          .alias(name) for c, name in columns.items()]
    ).write.mode("overwrite").csv(path, header=True, escape='"')
