"""Slicing of large cases and joins on hot keys change where work runs, never its result."""

import pytest
from pyspark.sql import functions as F

from tracewright import mine
from tracewright.catalog.logs import by_user
from tracewright.operators import activity, arcs, cases, model, sequence, variants
from tracewright.plans import skew
from tracewright.plans.ranks import medians, values_at_ranks
from tracewright.spec import PART


def same(left, right):
    columns = [c for c in left.columns if c != PART]
    assert sorted(map(repr, left.select(columns).collect())) == sorted(map(repr, right.select(columns).collect()))


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    return by_user(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def skewed(spark, whole):
    """One case holds half of all events, some of them with the same start."""
    hot = (F.col("event_seq") % 2 == 0)
    return whole.withColumn("trace", F.when(hot, "hot").otherwise(F.col("trace"))).withColumn(
        "timestamp", F.when(hot, F.floor(F.col("timestamp") / 90_000_000) * 90_000_000)
        .otherwise(F.col("timestamp"))).cache()


@pytest.fixture(scope="module")
def sliced(skewed):
    return skew.split_hot_cases(skewed.drop(PART), min_events=50).cache()


def test_the_columns_do_not_depend_on_the_size(whole):
    log = whole.drop(PART)
    few, many = skew.split_hot_cases(log), skew.split_hot_cases(log, min_events=5)
    assert few.dtypes == many.dtypes == [*log.dtypes, (PART, "int")]
    assert few.where(F.col(PART).isNotNull()).isEmpty() and skew.sliced(few) == [] and skew.sliced(many) == [PART]
    for op in (sequence.collapse_runs, sequence.prepare, sequence.sequence, sequence.traces, variants.variants):
        assert op(few).dtypes == op(many).dtypes


def test_more_large_cases_than_a_list_of_frequent_ones_holds(spark):
    log = spark.range(15_000).select(
        (F.col("id") % 1500).cast("string").alias("trace"), F.lit("a").alias("activity"),
        F.col("id").alias("timestamp"), F.col("id").alias("timestampf"), F.col("id").alias("event_seq"))
    cut = skew.split_hot_cases(log, min_events=9)
    assert cut.where(F.col(PART).isNull()).isEmpty() and cut.count() == 15_000
    same(sequence.sequence(log), sequence.sequence(cut))


def test_events_without_a_case_are_sliced_like_a_case(whole):
    log = whole.drop(PART).withColumn("trace", F.when(F.col("event_seq") % 2 == 0, F.col("trace")))
    cut = skew.split_hot_cases(log, min_events=100)
    assert cut.where(f"trace is null and {PART} is null").isEmpty()
    for op in (sequence.sequence, sequence.collapse_runs, sequence.traces, variants.variants, sequence.case_count):
        same(op(log), op(cut))


def test_only_the_hot_case_is_sliced_and_evenly(sliced):
    parts = {r["trace"]: r for r in sliced.groupBy("trace").agg(
        F.countDistinct(PART).alias("parts"), F.count("*").alias("n")).collect()}
    assert parts["hot"]["parts"] >= 5
    assert all(r["parts"] == 0 for t, r in parts.items() if t != "hot")
    largest = sliced.where("trace = 'hot'").groupBy(PART).count().agg(F.max("count")).first()[0]
    assert largest < parts["hot"]["n"] / 2


def test_slices_follow_the_order_of_events(sliced):
    ends = sliced.where(F.col(PART).isNotNull()).groupBy(PART).agg(
        F.min(F.struct("timestamp", "event_seq")).alias("low"), F.max(F.struct("timestamp", "event_seq")).alias("high")
    ).orderBy(PART).collect()
    assert all(a["high"] < b["low"] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("op", [
    sequence.sequence, sequence.collapse_runs, sequence.artificial_starts, sequence.add_dummies,
    sequence.padded_sequence, sequence.traces, cases.case_durations, cases.case_activity_times,
    variants.variants, variants.variant_cases, variants.variant_durations, variants.variant_frequency,
    arcs.directly_follows, arcs.arc_duration_stats, arcs.case_step_stats, model.dependencies,
    model.dependency_graph, activity.activity_durations,
    lambda log: sequence.traces(log, segment_events=7),
    lambda log: sequence.prepare(log, group=True, instant=True),
    lambda log: variants.variant_sequences(log, variants.variants(log), segment_events=7),
    lambda log: arcs.case_arcs(log, model.dependency_graph(log, 0.05)),
    lambda log: model.bindings(arcs.case_arcs(log, model.dependency_graph(log, 0.05))),
])
def test_sliced_cases_give_the_same_result(skewed, sliced, op):
    same(op(skewed), op(sliced))


def test_segments_put_together_are_the_case(skewed):
    parts = sequence.traces(skewed, segment_events=7)
    assert parts.agg(F.max(F.size("activities"))).first()[0] <= 9
    joined = parts.groupBy("trace").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("segment", "activities"))), lambda s: s["activities"])).alias("activities"))
    same(sequence.traces(skewed).select("trace", "activities"), joined)


def test_hot_variants_are_looked_up_apart(whole, make_cases, monkeypatch):
    log = make_cases(*["A B"] * 6, "A C", "A C", "B")
    expected = variants.variant_cases(log).collect()
    monkeypatch.setattr(variants, "HOT_VARIANT_CASES", 3)
    assert sorted(variants.variant_cases(log).collect()) == sorted(expected)
    assert len(expected) == 9


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_lookup_joins_agree_below_and_above_the_limit(spark, how):
    big = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    same(skew.join_lookup(big, small, ["k"], how), skew.join_lookup(big, small, ["k"], how, limit=1))


def test_dimension_joins_agree_below_and_above_the_limit(spark):
    facts = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    names = spark.range(6).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    facts = facts.unionByName(facts.where("id < 20").withColumn("k", F.lit(None).cast("long")))
    for limit in ({"limit": 1}, {"limit": 1, "hot_rows": 28}, {"limit": 5, "hot_rows": 1}):
        same(skew.join_dimension(facts, names, "k"), skew.join_dimension(facts, names, "k", **limit))


def test_values_at_ranks_by_brute_force(spark):
    values = [(k, (i * 7919 * (k + 1)) % 5_000_000_000 - 1000) for k in range(3) for i in range(301 + k)]
    df = spark.createDataFrame(values, "k long, v long")
    n = F.col("n")
    got = {r["k"]: r for r in values_at_ranks(
        df, ["k"], "v", {"low": F.lit(0), "third": F.floor(n / 3), "high": n - 1, "outside": n}).collect()}
    middle = {r["k"]: r["median"] for r in medians(df, ["k"], "v").collect()}
    for k in range(3):
        own = sorted(v for g, v in values if g == k)
        assert (got[k]["low"], got[k]["third"], got[k]["high"]) == (own[0], own[len(own) // 3], own[-1])
        assert got[k]["outside"] is None
        half = len(own) // 2
        assert middle[k] == (own[half] if len(own) % 2 else int((own[half - 1] + own[half]) / 2))


def test_median_of_one_repeated_value(spark):
    df = spark.range(1000).select(F.lit(5).cast("long").alias("v"))
    assert medians(df, [], "v").first()["median"] == 5


def test_mining_a_sliced_log_gives_the_same_tables(skewed, sliced):
    plain, cut = mine(skewed, group=True, threshold=0.05), mine(sliced, group=True, threshold=0.05)
    for name in ("events", "edges", "case_arcs", "variant_arcs", "longest_shortest_case", "longest_shortest_case_arcs"):
        same(plain[name], cut[name])


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), (None, 9), ("a", 4)], "k string, v long")
    assert {(r["k"], r["median"]) for r in medians(df, ["k"], "v").collect()} == {(None, 3), ("a", 4)}


def test_events_without_an_activity_have_durations(spark):
    log = spark.createDataFrame(
        [("c", None, 0, 10, 0), ("c", None, 10, 40, 1), ("c", "a", 40, 45, 2)],
        "trace string, activity string, timestamp long, timestampf long, event_seq long")
    rows = {r["activity"]: (r["total"], r["median"]) for r in activity.activity_durations(log).collect()}
    assert rows == {None: (40, 20), "a": (5, 5)}
