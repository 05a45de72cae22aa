"""XES logs event by event, and logs stored by case."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_plans import plan
from tracewright.operators import arcs, cases, sequence, variants
from tracewright.plans.skew import split_hot_cases
from tracewright.sources import open_log, read_xes_log, save_log, xes
from tracewright.spec import PART


def event(name, second):
    return (f'<event>\n<string key="org:resource" value="r &lt;event"/><string key="concept:name" value="{name}"/>'
            f'<date key="time:timestamp" value="2020-01-01T{second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}Z"/></event>')


def test_a_long_case_is_read_in_many_blocks(spark, tmp_path):
    sizes = {"first": 3, "long &amp; wide": 4000, "": 2, "last": 1}
    text = '<?xml version="1.0"?><log><global scope="event"><string key="concept:name" value="none"/></global><trace/>'
    for name, n in sizes.items():
        head = f'<string key="concept:name" value="{name}"/>' if name else '<string key="other" value="x"/>'
        text += f"<trace>{head}" + "".join(event(f"a{i}", i) for i in range(n)) + "</trace>\n<trace></trace>"
    (tmp_path / "one.xes").write_text(text + "</log>")
    (tmp_path / "two.xes").write_text(f'<log><trace><string key="concept:name" value="second file"/>{event("b", 0)}</trace></log>')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = read_xes_log(spark, str(tmp_path))
        assert xes._records(spark, str(tmp_path)).select("_file", "_block").distinct().count() > 5
        got = {r["case"]: r["n"] for r in rows.groupBy("case").agg(F.count("*").alias("n")).collect()}
        distinct = rows.select("event", "completeTime").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {"first": 3, "long & wide": 4000, None: 2, "last": 1, "second file": 1}
    assert distinct == 4001


@pytest.fixture(scope="module")
def log(spark):
    return spark.range(3000).select(
        F.concat(F.lit("c"), F.col("id") % 90).alias("trace"), F.concat(F.lit("a"), F.col("id") % 5).alias("activity"),
        (F.col("id") * 1000).alias("timestamp"), (F.col("id") * 1000 + 500).alias("timestampf"), F.col("id").alias("event_seq"))


def lines(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("op, shuffles", [
    (sequence.sequence, 0), (sequence.collapse_runs, 0), (sequence.artificial_starts, 0), (sequence.add_dummies, 0),
    (variants.fingerprints, 0), (cases.case_durations, 0), (arcs.directly_follows, 1), (variants.variants, 1),
])
def test_a_log_stored_by_case_is_not_shuffled_by_case(spark, log, tmp_path, op, shuffles):
    save_log(log, str(tmp_path / "log"), buckets=4)
    stored = open_log(spark, str(tmp_path / "log"))
    assert stored.columns == log.columns
    assert len(re.findall(r"^\(\d+\) Exchange", plan(op(stored)), flags=re.M)) == shuffles
    assert lines(op(stored)) == lines(op(log))


def test_a_sliced_log_is_stored_by_case_and_slice(spark, log, tmp_path):
    hot = split_hot_cases(log.withColumn("trace", F.when(F.col("event_seq") % 3 == 0, "hot").otherwise(F.col("trace"))), min_events=200)
    save_log(hot, str(tmp_path / "hot"), buckets=8)
    stored = open_log(spark, str(tmp_path / "hot"))
    sizes = [r["count"] for r in stored.where("trace = 'hot'").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and PART in stored.columns
    assert lines(sequence.sequence(stored).drop(PART)) == lines(sequence.sequence(hot).drop(PART))
    # windows inside slices need no shuffle; the table of their borders is small
    assert "hashpartitioning(trace#" not in re.sub(r"case_part", "", plan(stored.groupBy("trace", PART).count()))


def test_an_opened_log_is_read_from_where_it_lies(spark, log, tmp_path):
    path = str(tmp_path / "log")
    save_log(log.limit(10), path)
    save_log(log, path)
    assert open_log(spark, path).count() == 3000
    assert "PushedFilters: [IsNotNull(activity), EqualTo(activity,a1)]" in plan(open_log(spark, path).where("activity = 'a1'"))
