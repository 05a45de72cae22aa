"""Slices of a log by attribute values, and statistics of all slices in one job.

A branch is a list of levels; a level maps columns to the values allowed there, or to SPLIT. Levels
add up down the branch: level 2 also meets the conditions of level 1. SPLIT makes one slice per
value found, and the levels below it are repeated for each. Slice `0` is the whole log.

A slice is named by branch number, level number and the values it was split by, for example
`1.2[region=EUROPE]`; a comma, equals sign, bracket or backslash in a value has a backslash before it. The name follows from the row itself, so no list of values is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.cleaning import attribute_predicate
from tracewright.spec import LogSpec

SPLIT = "SPLIT"
ROOT = "0"
BRANCH = "branch_id"

Level = Mapping[str, Sequence | str]


def _marked(value: Column) -> Column:
    """A value with a backslash before the signs that stand between values, so that names of slices differ."""
    return F.regexp_replace(value, r"([\\,=\[\]])", r"\\$1")


def _slices(
    branches: Sequence[Sequence[Level]], spec: LogSpec | None, only_leaves: bool
) -> list[tuple[Column, Column]]:
    """A predicate and a description for each (branch, level); `only_leaves` keeps last levels."""
    roles = spec.roles() if spec else {}

    def describe(name: Column, parent: Column, level: int, label: Column, conditions: Column) -> Column:
        return F.struct(name.alias(BRANCH), parent.alias("parent_id"), F.lit(level).alias("level"),
                        label.alias("label"), conditions.alias("filter"))

    out = []
    if not (only_leaves and branches):
        out.append((F.lit(True), describe(
            F.lit(ROOT), F.lit(None).cast("string"), 0, F.lit("ROOT"),
            F.create_map().cast("map<string,array<string>>"))))
    for number, levels in enumerate(branches, start=1):
        fixed: dict[str, list] = {}
        split: list[str] = []
        parent = F.lit(ROOT)
        for depth, level in enumerate(levels, start=1):
            for column, values in level.items():
                column = roles.get(column, column)
                fixed.pop(column, None)
                split = [c for c in split if c != column]
                if values == SPLIT:
                    split.append(column)
                else:
                    fixed[column] = list(values)
            by = [F.concat(F.lit(f"{c}="), _marked(F.col(c).cast("string"))) for c in split]
            name = F.concat(F.lit(f"{number}.{depth}["), F.concat_ws(",", *by), F.lit("]")) \
                if by else F.lit(f"{number}.{depth}")
            conditions = F.create_map(*[x for c in [*fixed, *split] for x in (
                F.lit(c), F.array(*[F.lit(str(v)) for v in fixed[c]]) if c in fixed
                else F.array(F.col(c).cast("string")))])
            predicate = reduce(lambda p, c: p & F.col(c).isNotNull(), split, attribute_predicate(fixed))
            if not only_leaves or depth == len(levels):
                out.append((predicate, describe(name, parent, depth, F.lit(list(level)[-1]), conditions)))
            parent = name
    return out


def expand_branches(
    branches: Sequence[Sequence[Level]], df: DataFrame, only_leaves: bool = False,
    spec: LogSpec | None = None,
) -> DataFrame:
    """The slices that hold data: `branch_id, parent_id, level, label, filter`."""
    found = F.array_compact(F.array(*[F.when(p, d) for p, d in _slices(branches, spec, only_leaves)]))
    # a map cannot be grouped by, and the name settles all else: keep any one description per name
    return (
        df.select(F.inline(found))
        .groupBy(BRANCH, "parent_id", "level", "label")
        .agg(F.any_value("filter").alias("filter"))
    )


def tag_branches(
    df: DataFrame, branches: Sequence[Sequence[Level]], only_leaves: bool = False,
    spec: LogSpec | None = None,
) -> DataFrame:
    """Each event once per slice it belongs to, with the `branch_id`."""
    names = F.array_compact(F.array(*[F.when(p, d[BRANCH]) for p, d in _slices(branches, spec, only_leaves)]))
    return df.withColumn(BRANCH, F.explode(names))


def branch_number() -> Column:
    """The number of the branch that a slice belongs to; 0 is the whole log."""
    return F.regexp_extract(BRANCH, r"^(\d+)", 1).cast("int")


def run_branches(
    df: DataFrame, branches: Sequence[Sequence[Level]], op: Callable[..., DataFrame],
    only_leaves: bool = False, spec: LogSpec | None = None,
) -> DataFrame:
    """A statistic of every slice in a single job: `op(events, keys=["branch_id"])`."""
    return op(tag_branches(df, branches, only_leaves, spec), keys=[BRANCH])
