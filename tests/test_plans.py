"""What the plans must keep: few shuffles, early filters, few columns."""

import contextlib
import io
import pathlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewright import catalog
from tracewright.catalog import logs
from tracewright.operators import activity, arcs, branches, cases, cleaning, model, sequence, variants
from tracewright.plans.storage import SHUFFLES_GO, materialize, store
from tracewright.sources import load_log


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def shuffles(df):
    return re.findall(r"^\(\d+\) Exchange.*?Arguments: (\w+)", plan(df), flags=re.S | re.M)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "log")
    spark.range(2000).select(
        (F.col("id") % 300).cast("string").alias("trace"), F.concat(F.lit("a"), F.col("id") % 7).alias("activity"),
        (F.col("id") * 1000).alias("timestamp"), (F.col("id") * 1000 + 500).alias("timestampf"),
        F.col("id").alias("event_seq"), F.lit("red").alias("colour"), F.lit("unused").alias("other"),
    ).write.parquet(path)
    return load_log(spark, path)


@pytest.mark.parametrize("op, expected", [
    (sequence.sequence, 1), (sequence.collapse_runs, 1), (sequence.artificial_starts, 1),
    (sequence.add_dummies, 1), (sequence.padded_sequence, 1), (sequence.traces, 1),
    (lambda log: sequence.prepare(log, group=True, instant=True), 1),
    (arcs.case_step_stats, 1), (variants.fingerprints, 1), (cases.case_durations, 1),
    # and one more to count by activity, arc or fingerprint
    (arcs.directly_follows, 2), (arcs.arc_duration_stats, 2), (variants.variants, 2), (variants.variant_durations, 2),
    (model.dependencies, 3), (activity.activity_averages, 1),
])
def test_one_shuffle_by_case(stored, op, expected):
    found = shuffles(op(stored))
    assert found == ["hashpartitioning"] * expected


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(activity.activity_averages(cleaning.filter_interval(
        cleaning.filter_attributes(stored, {"colour": ["red", "blue"]}), 10, 10_000)))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "In(colour, [blue,red])" in pushed or "In(colour, [red,blue])" in pushed
    assert "GreaterThanOrEqual(timestamp,10)" in pushed and "LessThanOrEqual(timestamp,10000)" in pushed
    read = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "other" not in read and "event_seq" not in read and "trace" not in read


def test_all_branches_are_one_scan_and_one_aggregation(stored):
    levels = [[{"colour": branches.SPLIT}, {"activity": ["a1", "a2"]}], [{"activity": ["a3"]}]]
    counted = branches.run_branches(stored, levels, activity.activity_averages)
    assert shuffles(counted) == ["hashpartitioning"]
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan(counted), flags=re.M)) == 1


def test_nothing_is_collected_into_a_single_partition_but_aggregates(stored):
    for op in (sequence.traces, variants.variants, arcs.directly_follows, model.dependency_graph):
        assert "SinglePartition" not in plan(op(stored))


def test_map_only_queries_compute_nothing_ahead(spark, sf_dir):
    tracker = spark.sparkContext.statusTracker()
    queries = catalog.queries()
    for name in ("filter_interval", "activity_relative_frequency", "case_count", "case_durations"):
        before = len(tracker.getJobIdsForGroup(None))
        queries[name](spark, sf_dir)
        # reading the columns of a Parquet file is a job of one task
        assert len(tracker.getJobIdsForGroup(None)) - before <= 1


def test_a_log_is_sliced_once_for_all_queries(spark, sf_dir):
    assert logs.daily(spark, sf_dir) is logs.daily(spark, sf_dir)


@pytest.fixture
def fixed_plans(spark):
    """Without adaptive execution a plan shows which shuffles are used twice."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_arcs_of_cases_are_not_shuffled_by_arc(stored):
    edges = materialize(model.dependency_graph(stored, 0.1))
    text = plan(arcs.case_arcs(stored, edges))
    keys = re.findall(r"Arguments: hashpartitioning\(([^)]*), \d+\)", text)
    assert keys and not any("src" in k or "dst" in k for k in keys if "trace" in k or "variant_id" in k)


def test_durations_come_from_one_table_of_counts(stored, fixed_plans):
    text = plan(activity.activity_durations(stored))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, flags=re.M)) == 1 and "ReusedExchange" in text


def test_a_stored_table_leaves_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for folder in folders for f in pathlib.Path(folder).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(SHUFFLES_GO, None)
    table = store(spark.range(20_000).repartition(3, "id"), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 20_000
    assert spark.conf.get(SHUFFLES_GO, None) == setting
