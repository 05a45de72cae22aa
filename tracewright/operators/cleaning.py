"""Projections, predicates and cleaning of a log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import normalize_activity
from tracewright.spec import ACTIVITY, COMPLETE, EMPTY, END_TASK, SEQ, START, START_TASK, TRACE, LogSpec



def standardize(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Bring the paired columns to the standard names and types; all others are kept as they are.

    Without a sequence column, events of a case with the same start get a fixed order from their
    complete time and activity, so that it does not depend on how the input was split. A time that
    does not follow the pattern is null; `rejected` returns the rows that have one.
    """
    roles = {spec.trace, spec.activity, spec.start, spec.complete, spec.sequence}

    def millis(column: str) -> Column:
        return F.unix_millis(_time(df, column, spec))

    standard = df.select(
        F.col(f"`{spec.trace}`").cast("string").alias(TRACE),
        normalize_activity(F.col(f"`{spec.activity}`")).alias(ACTIVITY),
        millis(spec.start).alias(START),
        millis(spec.complete).alias(COMPLETE),
        *([F.col(f"`{spec.sequence}`").cast("long").alias(SEQ)] if spec.sequence else []),
        *[F.col(f"`{c}`") for c in df.columns if c not in roles],
    )
    if spec.sequence:
        return standard
    return standard.withColumn(SEQ, F.lit(0).cast("long"))


def _time(df: DataFrame, column: str, spec: LogSpec) -> Column:
    cell = F.col(f"`{column}`")
    if dict(df.dtypes)[column] == "string":
        return F.try_to_timestamp(cell, F.lit(spec.pattern))
    return F.to_timestamp(cell, spec.pattern)


def rejected(df: DataFrame, spec: LogSpec) -> DataFrame:
    """The rows that `standardize` can not read a time of, as they are, to be counted or looked at."""
    bad = [F.col(f"`{c}`").isNotNull() & _time(df, c, spec).isNull() for c in (spec.start, spec.complete)]
    return df.where(bad[0] | bad[1])


def fill_empty(df: DataFrame, token: str = EMPTY) -> DataFrame:
    """Put the token into every empty or missing text cell."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[
        F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) == "", token).otherwise(F.col(f"`{c}`")).alias(c)
        if c in text else F.col(f"`{c}`") for c in df.columns])


def fix_case_dots(df: DataFrame, column: str) -> DataFrame:
    """Write `0` for every `.` of a case id. It can merge ids, so nothing does it unasked."""
    return df.withColumn(column, F.translate(F.col(column).cast("string"), ".", "0"))


def replace_nulls(df: DataFrame, column: str, value: str) -> DataFrame:
    """Put a value where the cell was empty."""
    return df.replace(EMPTY, value, subset=[column])


def replace_values(df: DataFrame, column: str, values: Sequence[str], new: str) -> DataFrame:
    """Put one value in place of any of the listed ones."""
    return df.withColumn(column, F.when(F.col(column).isin(list(values)), new).otherwise(F.col(column)))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The different values of each column as `(column, value)`, in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).distinct()


def attribute_predicate(conditions: Mapping[str, Sequence], spec: LogSpec | None = None) -> Column:
    """AND over the columns, OR over the values of each; role columns may go by the user's name."""
    roles = spec.roles() if spec else {}
    return reduce(and_, [F.col(roles.get(c, c)).isin(list(v)) for c, v in conditions.items()], F.lit(True))


def filter_attributes(
    df: DataFrame, conditions: Mapping[str, Sequence], spec: LogSpec | None = None
) -> DataFrame:
    """Keep the events whose attributes all have one of the listed values."""
    return df.where(attribute_predicate(conditions, spec))


def filter_interval(df: DataFrame, first: int, last: int) -> DataFrame:
    """Keep the events that start within the interval, ends included."""
    return df.where(F.col(START).between(first, last))


def order_log(df: DataFrame) -> DataFrame:
    """Sort by case, then complete time."""
    return df.orderBy(TRACE, COMPLETE, *([SEQ] if SEQ in df.columns else []))


def drop_dummies(df: DataFrame) -> DataFrame:
    """Leave out the synthetic first and last activities. Events without an activity stay."""
    return df.where(~F.coalesce(F.col(ACTIVITY).isin(START_TASK, END_TASK), F.lit(False)))


def sample_time(df: DataFrame, column: str) -> DataFrame:
    """One example of how the log writes its times: the smallest."""
    return df.agg(F.min(column).alias("sample"))
