"""Everything that mining a log yields, as named tables."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame

from tracewright.operators import activity, arcs, buckets, cases, loops, model, patterns, sequence, variants, workflow
from tracewright.operators.branches import BRANCH, Level, branch_number, expand_branches, tag_branches
from tracewright.operators.cleaning import drop_dummies
from tracewright.plans.skew import sliced
from tracewright.plans.storage import materialize, store
from tracewright.spec import ACTIVITY, PART, LogSpec


def _events(
    log: DataFrame, keys: Sequence[str], group: bool | Collection[int], instant: bool
) -> DataFrame:
    """The prepared events; `group` is for all, or for the branches of those numbers."""
    if isinstance(group, bool):
        return sequence.prepare(log, keys, group=group, instant=instant)
    grouped = branch_number().isin([int(g) for g in group])
    parts = [sequence.prepare(log.where(which), keys, group=runs, instant=instant)
             for which, runs in ((grouped, True), (~grouped, False))]
    return parts[0].unionByName(parts[1])


def mine(
    log: DataFrame, group: bool | Collection[int] = False, instant: bool = False, threshold: float = model.THRESHOLD, top: int = 3,
    branches: Sequence[Sequence[Level]] | None = None, only_leaves: bool = False, mined: Collection[int] | None = None,
    spec: LogSpec | None = None, prune: Sequence[float] = (), frequent: Sequence[float] = (), infrequent: Sequence[float] = (),
) -> dict[str, DataFrame]:
    """Model, activity, case, variant and arc statistics of one log, ready for `save_tables`.

    `group` makes one event of consecutive equal activities, `instant` makes up start times. The
    prepared events, the model and the arcs of the variants are computed once and stored; all other
    tables are lazy and read those. `prune`, `frequent` and `infrequent` are thresholds: of pruned
    arcs, and of patterns, which are only searched if there are any.

    With `branches` (see `operators.branches`) all slices of the log are mined in the same jobs: every
    table has the column `branch_id`, each slice its own model, loops and patterns, and the table
    `branches` describes the slices. `group` and `mined` may then be numbers of branches (0 is the whole
    log): those whose runs are collapsed, and those that are mined at all.
    """
    keys = [] if branches is None else [BRANCH]
    tables = {}
    if branches is not None:
        described = expand_branches(branches, log, only_leaves, spec)
        log = tag_branches(log, branches, only_leaves, spec)
        if mined is not None:
            wanted = branch_number().isin([int(m) for m in mined])
            described, log = described.where(wanted), log.where(wanted)
        tables["branches"] = described
    elif mined is not None or not isinstance(group, bool):
        raise ValueError("numbers of branches need branches")
    few = not keys
    events = store(_events(log, keys, group, instant), "events")
    if PART in log.columns and not sliced(log):
        events = events.drop(PART)
    log = drop_dummies(events)
    edges = materialize(model.clean_model(model.dependency_graph(log, threshold, keys=keys), keys))
    nodes = model.model_nodes(log, edges, keys)
    case_arcs = store(arcs.case_arcs(log, edges, keys=keys), "case-arcs")
    arc_frequency = store(arcs.arc_frequency(case_arcs, keys), "arc-frequency")
    found_loops = loops.loops(edges, keys)
    counted = materialize(variants.top_variants(log, top, keys))
    extremes = materialize(cases.longest_shortest_case(log, keys))
    of_activities = activity.activity_frequency(events, keys)
    durations = activity.activity_averages(events, keys).select(*keys, ACTIVITY, "mean")
    kept = arcs.arc_nodes(edges, keys)
    by_count = buckets.bucket_equal_count(arc_frequency, "frequency", keys=keys)
    tables |= {
        "events": events.drop(PART),
        "traces": sequence.traces(log, keys),
        "edges": edges,
        "nodes": nodes,
        "bindings": model.bindings(case_arcs, keys),
        "case_arcs": case_arcs,
        "log_span": activity.log_span(events, keys),
        "activity_frequency": activity.activity_relative_frequency(events, keys),
        "activity_frequency_by_quartile": activity.activity_frequency_by_quartile(events, keys),
        "activity_durations": activity.activity_durations(events, keys),
        "activity_duration_share": activity.activity_duration_share(events, keys),
        "longest_shortest_activity": activity.longest_shortest_activity(events, keys),
        "activity_buckets": buckets.bucket_equal_width(of_activities, "n", kept=kept, keys=keys),
        "activity_buckets_by_count": buckets.bucket_equal_count(of_activities, "n", kept=kept, keys=keys),
        "duration_buckets": buckets.bucket_equal_width(durations, "mean", whole_steps=True, kept=kept, keys=keys),
        "duration_buckets_by_count": buckets.bucket_equal_count(durations, "mean", kept=kept, keys=keys),
        "case_extents": cases.case_extents(log, keys),
        "case_five_numbers": cases.duration_five_numbers(log, keys),
        "variant_frequency": variants.variant_frequency(log, top, keys),
        "variant_compliance": variants.variant_compliance(log, top, keys),
        "variant_durations": variants.variant_durations(log, keys),
        "variant_arcs": arcs.variant_arcs(log, edges, counted, keys=keys, few=few),
        "longest_shortest_case": cases.case_activities(log, extremes, keys, few=few),
        "longest_shortest_case_arcs": arcs.arcs_of_reported_cases(log, edges, extremes, keys, few=few),
        "arc_frequency": arc_frequency,
        "arc_buckets": buckets.bucket_equal_width(arc_frequency, "frequency", keys=keys),
        "arc_buckets_by_count": by_count,
        "arc_bucket_bounds": buckets.bounds_equal_width(arc_frequency, "frequency", keys=keys),
        "arc_bucket_bounds_by_count": buckets.bounds_equal_count(by_count, "frequency", keys=keys),
        "loops": loops.loop_share(found_loops, arc_frequency, keys),
    }
    if prune:
        pruned = arcs.prune_arcs_many(arc_frequency, prune, keys)
        tables |= {"pruned_arcs": pruned, "pruned_nodes": arcs.arc_nodes(pruned, [*keys, "threshold"])}
    n_cases = sequence.case_count(log, keys)
    for kind, thresholds in (("frequent", frequent), ("infrequent", infrequent)):
        if thresholds:
            total = materialize(n_cases) if keys else n_cases.first()["n_cases"]
            found = store(patterns.patterns_many(case_arcs, total, thresholds, kind, keys=keys), f"{kind}-patterns")
            tables |= {f"{kind}_patterns": found, f"{kind}_pattern_summary": patterns.pattern_summary(found, keys)}
    return tables


def report(log: DataFrame, workflow_column: str, category_column: str) -> dict[str, DataFrame]:
    """The workflow and category report: the table of cases is computed once, all others read it."""
    extents = store(workflow.case_completion_extents(log, workflow_column, category_column), "cases")
    timeline = workflow.category_timeline(extents)
    return {
        "cases": extents,
        "workflow_share": workflow.workflow_share(extents),
        "workflow_categories": workflow.workflow_categories(extents),
        "workflow_durations": workflow.workflow_durations(extents),
        "workflow_category_matrix": workflow.workflow_category_matrix(extents),
        "bin_width": workflow.report_bin_width(extents),
        "category_timeline": workflow.category_timeline_share(timeline),
    }
