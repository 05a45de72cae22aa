"""Hand-made logs, one for each rule that is easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright import LogSpec, mine, report
from tracewright.functions import format_duration, normalize_activity, simplify_name, strip_accents
from tracewright.operators import activity, arcs, branches, buckets, cases, cleaning, loops, model, sequence, variants
from tracewright.operators import workflow as W
from tracewright.sources import export_csv, load_log, read_csv_log, read_typed_log, read_xes_log, save_tables
from tracewright.spec import END_TASK, START_TASK


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("v")).first()["v"]


def test_ties_go_by_sequence_number(make_log):
    log = make_log(("a", "X", 5, 6), ("a", "Y", 5, 7), ("a", "Z", 1, 2))
    assert values(sequence.sequence(log).orderBy("pos"), "activity") == [("Z",), ("X",), ("Y",)]


def test_run_ends_with_its_last_event_not_the_latest(make_log):
    log = make_log(*[("a", n, t, c) for n, t, c in (
        ("A", 1, 2), ("A", 3, 90), ("B", 4, 5), ("B", 6, 99), ("B", 7, 8), ("A", 9, 10))])
    found = sequence.collapse_runs(log).orderBy("timestamp")
    assert values(found, "activity", "timestamp", "timestampf") == [("A", 1, 90), ("B", 4, 8), ("A", 9, 10)]
    assert sorted(sequence.collapse_runs(found).collect()) == sorted(found.collect())


def test_case_ends_with_the_last_event_by_start(make_log):
    log = make_log(("a", "X", 1, 100), ("a", "Y", 2, 3))
    assert values(cases.case_durations(log), "first_time", "last_time", "duration") == [(1, 3, 2)]
    rows = values(sequence.add_dummies(log).orderBy("timestamp", "event_seq"), "activity", "timestamp", "timestampf")
    assert rows == [(START_TASK, -999, 1), ("X", 1, 100), ("Y", 2, 3), (END_TASK, 3, 1003)]


def test_made_up_starts_take_the_previous_completion(make_log):
    log = make_log(("a", "X", 10, 10), ("a", "Y", 25, 25), ("b", "X", 3, 3))
    assert sorted(values(sequence.artificial_starts(log), "trace", "timestamp", "timestampf")) == [
        ("a", 10, 10), ("a", 10, 25), ("b", 3, 3)]


def test_dummies_leave_other_attributes_empty(make_log):
    log = make_log(("a", "X", 1, 2)).withColumn("colour", F.lit("red"))
    assert sorted(values(sequence.add_dummies(log), "activity", "colour"), key=str) == sorted(
        [("X", "red"), (START_TASK, None), (END_TASK, None)], key=str)


@pytest.mark.parametrize("n, expected", [
    (4, []), (5, [("min", 10), ("q1", 20), ("q2", 30), ("q3", 40), ("max", 50)])])
def test_five_numbers_need_more_than_four_cases(make_log, n, expected):
    log = make_log(*[(i, "X", 0, 10 * i) for i in range(1, n + 1)])
    assert values(cases.duration_five_numbers(log), "rank_name", "duration") == expected


def test_means_and_even_medians_are_cut_off(make_log):
    log = make_log(*[("a", "X", 0, d) for d in (1, 2)], *[("a", "Y", 0, d) for d in (1, 4)])
    rows = {r["activity"]: r for r in activity.activity_durations(log).collect()}
    assert (rows["X"]["mean"], rows["X"]["median"], rows["Y"]["mean"], rows["Y"]["median"]) == (1, 1, 2, 2)
    assert rows["X"]["deviation"] == pytest.approx(math.sqrt(0.5))
    assert rows["Y"]["deviation"] == pytest.approx(math.sqrt((1 + 4) / 2))


def test_quartiles_do_not_carry_over_between_logs(make_log):
    first, second = make_log(("a", "X", 0, 403)), make_log(("a", "X", 1000, 1400))
    assert values(activity.quartile_intervals(first), "quartile", "first", "last") == [
        (1, 0, 100), (2, 101, 200), (3, 201, 300), (4, 301, 403)]
    assert values(activity.quartile_intervals(second), "first", "last")[0] == (1000, 1100)


def test_interval_stretches_by_the_dummies(make_log):
    log = make_log(("a", "X", 5000, 6000))
    assert values(activity.log_interval(sequence.add_dummies(log)), "first", "last") == [(4000, 7000)]


def test_quartile_shares_leave_dummies_out_and_sum_to_one(make_log):
    log = make_log(("a", "X", 0, 1), ("a", "Y", 1, 2), ("a", "X", 9000, 9001))
    rows = activity.activity_frequency_by_quartile(sequence.add_dummies(log))
    assert sorted(values(rows, "quartile", "activity", "share")) == [(1, "X", 0.5), (1, "Y", 0.5), (4, "X", 1.0)]


@pytest.mark.parametrize("days, width", [(1, W.DAY), (29, W.DAY), (100, W.WEEK), (2000, W.MONTH), (9000, W.MONTH)])
def test_bins_get_wider_with_the_span(make_log, days, width):
    log = make_log(("a", "X", 0, 0), ("b", "X", 0, days * W.DAY)).withColumns(
        {"w": F.lit("w"), "c": F.lit("c")})
    extents = W.case_completion_extents(log, "w", "c")
    assert W.report_bin_width(extents).first()["width"] == width
    line = W.category_timeline_share(W.category_timeline(extents)).orderBy("bin").collect()
    assert [r["bin"] for r in line] == list(range(days * W.DAY // width + 1))
    assert sum(r["n"] for r in line) == 2
    assert all((r["share"] is None) == (r["total"] == 0) for r in line)


def test_workflow_shares_sum_to_one(make_log):
    log = make_log(*[(i, "X", 0, 1) for i in range(5)]).withColumn("c", F.lit("c")).withColumn(
        "w", F.when(F.col("trace") < "3", "big").otherwise(F.concat(F.lit("w"), "trace")))
    assert sorted(values(W.workflow_share(W.case_completion_extents(log, "w", "c")), "workflow", "n", "share")) == [
        ("big", 3, 0.6), ("w3", 1, 0.2), ("w4", 1, 0.2)]


def test_workflow_of_a_case_is_that_of_its_first_event(spark):
    log = spark.createDataFrame([("a", "X", 5, 6, 0, "late", "l"), ("a", "X", 1, 2, 1, "early", "e")],
                                "trace string, activity string, timestamp long, timestampf long, event_seq long, w string, c string")
    assert values(W.case_completion_extents(log, "w", "c"), "first_complete", "last_complete", "workflow", "category") == [
        (2, 6, "early", "e")]


LEVELS = [[{"r": ["n", "s"]}, {"k": branches.SPLIT}, {"m": ["x"]}], [{"m": ["y"]}]]


@pytest.fixture
def regions(spark):
    rows = [("n", "1", "x"), ("s", "1", "y"), ("n", "2", "x"), ("w", "1", "x"), ("s", None, "x")]
    return spark.createDataFrame([(str(i), "A", i, i, i, *r) for i, r in enumerate(rows)],
                                 "trace string, activity string, timestamp long, timestampf long, event_seq long,"
                                 " r string, k string, m string")


def test_branches_add_up_and_split_below_each_value(regions):
    rows = {r["branch_id"]: r for r in branches.expand_branches(LEVELS, regions).collect()}
    assert set(rows) == {"0", "1.1", "1.2[k=1]", "1.2[k=2]", "1.3[k=1]", "1.3[k=2]", "2.1"}
    assert rows["1.3[k=2]"]["parent_id"] == "1.2[k=2]"
    assert rows["1.3[k=2]"]["filter"] == {"r": ["n", "s"], "k": ["2"], "m": ["x"]}
    assert rows["0"]["filter"] == {} and rows["1.1"]["parent_id"] == "0"


def test_only_leaves_keeps_last_levels_at_any_depth(regions):
    counted = branches.run_branches(regions, LEVELS, activity.activity_frequency, only_leaves=True)
    assert sorted(values(counted, "branch_id", "n")) == [("1.3[k=1]", 1), ("1.3[k=2]", 1), ("2.1", 1)]


def test_a_missing_value_matches_no_filter(regions):
    assert cleaning.filter_attributes(regions, {"k": ["1", "2"]}).count() == 4
    assert cleaning.filter_attributes(regions, {"r": ["s"], "m": ["x", "y"]}).count() == 2


@pytest.mark.parametrize("op", [
    sequence.sequence, sequence.collapse_runs, sequence.add_dummies, sequence.traces, variants.variants,
    variants.variant_cases, variants.variant_durations, activity.activity_durations, activity.log_span,
    activity.activity_frequency_by_quartile, activity.longest_shortest_activity, activity.activity_duration_share,
    cases.case_durations, cases.longest_shortest_case, cases.duration_five_numbers, cases.median_case_duration,
    arcs.directly_follows, arcs.arc_duration_stats, arcs.extreme_step_cases, model.dependency_graph,
    sequence.case_count, activity.quartile_intervals,
])
def test_all_branches_in_one_job_equal_each_alone(make_cases, op):
    log = make_cases("A B C", "A B B", "C", "A B C A", "B A", "B", "C C").withColumn("k", F.col("trace") < "c004")
    levels = [[{"k": [True]}], [{"activity": ["A", "B"]}]]
    whole = branches.run_branches(log, levels, op)
    for name, part in (("0", log), ("1.1", log.where("k")), ("2.1", log.where("activity in ('A', 'B')"))):
        alone = op(part)
        together = whole.where(F.col("branch_id") == name).select(alone.columns)
        assert sorted(map(str, together.collect())) == sorted(map(str, alone.collect())), name


def test_equal_values_share_a_bucket(spark):
    df = spark.createDataFrame([("a", 9), ("b", 9), ("c", 4), ("d", 1)], "activity string, v long")
    assert sorted(values(buckets.bucket_equal_count(df, "v"), "activity", "bucket")) == [
        ("a", 2), ("b", 2), ("c", 1), ("d", 0)]
    assert sorted(values(buckets.bucket_equal_width(df, "v"), "activity", "bucket")) == [
        ("a", 3), ("b", 3), ("c", 1), ("d", 0)]


@pytest.mark.parametrize("n", range(1, 10))
def test_equal_count_halves_and_halves_again(spark, n):
    df = spark.range(1, n + 1).select("id")
    best = sorted(range(1, n + 1), reverse=True)
    upper, lower = best[:n // 2], best[n // 2:]
    parts = [lower[len(lower) // 2:], lower[:len(lower) // 2], upper[len(upper) // 2:], upper[:len(upper) // 2]]
    got = buckets.bucket_equal_count(df, "id").collect()
    assert {r["id"]: r["bucket"] for r in got} == {v: b for b, part in enumerate(parts) for v in part}


def test_buckets_take_their_width_from_all_rows_but_keep_some(spark):
    df = spark.createDataFrame([("a", 8), ("b", 3), ("c", 7)], "activity string, v long")
    kept = df.where("activity <> 'a'").select("activity")
    assert sorted(values(buckets.bucket_equal_width(df, "v", kept=kept), "activity", "bucket")) == [("b", 1), ("c", 3)]
    # 7 // 4 = 1, so whole steps put 3 at the top
    low = df.where("v < 8")
    assert sorted(values(buckets.bucket_equal_width(low, "v", whole_steps=True), "activity", "bucket")) == [
        ("b", 3), ("c", 3)]


def test_bucket_bounds(spark):
    df = spark.range(1, 9).select(F.col("id").alias("v"))
    assert values(buckets.bounds_equal_width(df, "v"), "bucket", "low", "high") == [
        (0, 0.0, 2.0), (1, 2.0, 4.0), (2, 4.0, 6.0), (3, 6.0, 8.0)]
    limits = buckets.bounds_equal_count(buckets.bucket_equal_count(df, "v"), "v").orderBy("bucket")
    assert values(limits, "low", "high") == [(1, 2), (2, 4), (4, 6), (6, 8)]


def test_loops_of_length_one_and_back(spark):
    model_arcs = spark.createDataFrame(
        [(START_TASK, "A"), ("A", "B"), ("B", "B"), ("B", "A"), ("A", "C"), ("C", END_TASK)], "src string, dst string")
    found = loops.loops(model_arcs)
    assert sorted(values(found, "kind", "src", "dst")) == [("return", "B", "A"), ("self", "B", "B")]
    assert sorted(values(loops.loop_nodes(found), "kind", "activity")) == [("return", "B"), ("self", "B")]
    used = spark.createDataFrame([("A", "B", 6), ("B", "B", 2)], "src string, dst string, frequency long")
    assert sorted(values(loops.loop_share(found, used), "kind", "frequency", "share")) == [
        ("return", 0, 0.0), ("self", 2, 25.0)]


def test_an_arc_to_a_nearer_node_without_a_way_back_is_no_loop(spark):
    model_arcs = spark.createDataFrame(
        [(START_TASK, "A"), ("A", "B"), ("B", "C"), (START_TASK, "D"), ("C", "D"), ("D", END_TASK)], "src string, dst string")
    assert loops.loops(model_arcs).count() == 0


def test_model_of_a_plain_process(make_cases):
    edges = model.dependency_graph(make_cases(*["A B C"] * 20, *["A C"] * 2))
    assert sorted(values(edges, "src", "dst")) == [
        ("A", "B"), ("B", "C"), ("C", END_TASK), (START_TASK, "A")]


def test_two_step_loop_keeps_both_directions(make_cases):
    log = make_cases(*["A B A B A C"] * 20)
    pairs = {(r["src"], r["dst"]): r for r in model.dependencies(log).collect()}
    assert pairs["A", "B"]["two_step"] == pytest.approx(60 / 61)
    assert pairs["A", "B"]["dependency"] == 0.0
    assert {("A", "B"), ("B", "A")} <= set(values(model.dependency_graph(log), "src", "dst"))


def test_unconnected_activities_get_their_best_arcs(make_cases):
    log = make_cases("A B", "B A", "A B", "A X B")
    loose = set(values(model.dependency_graph(log, threshold=0.99), "src", "dst"))
    ends = {a for arc in loose for a in arc}
    assert ends == {"A", "B", "X", START_TASK, END_TASK}
    assert model.dependency_graph(log, threshold=0.99, connect_all=False).count() == 0


def test_clean_model_drops_what_only_leads_to_itself(spark):
    edges = spark.createDataFrame([("A", "B", 1), ("B", "B", 1), ("C", "C", 5)], "src string, dst string, frequency long")
    assert sorted(values(model.clean_model(edges), "src", "dst")) == [("A", "B"), ("B", "B")]


def test_pruning_is_strict_and_keeps_all_at_zero(spark):
    df = spark.createDataFrame([("A", "B", 10), ("B", "C", 5), ("C", "D", 1)], "src string, dst string, frequency long")
    assert arcs.prune_arcs(df, 0.5).count() == 1
    assert arcs.prune_arcs(df, 0.0).count() == 3
    many = arcs.prune_arcs_many(df, [0.05, 0.5]).groupBy("threshold").count()
    assert sorted(values(many, "threshold", "count")) == [(0.05, 3), (0.5, 1)]


def test_totals_agree(make_cases):
    log = make_cases("A B C", "A B C", "B", "C A B B A")
    n_events, n_cases = log.count(), sequence.case_count(log).first()["n_cases"]
    assert activity.activity_frequency(log).agg(F.sum("n")).first()[0] == n_events
    assert activity.activity_relative_frequency(log).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert variants.variants(log).agg(F.sum("n")).first()[0] == n_cases
    assert arcs.directly_follows(log).agg(F.sum("frequency")).first()[0] == n_events - n_cases


def test_variants_tell_apart_what_only_differs_in_order(make_cases):
    found = variants.variants(make_cases("A B", "B A", "A B", "A B A", "A A B"))
    assert sorted(values(found, "variant_id", "n_events", "n")) == [
        ("c000", 2, 2), ("c001", 2, 1), ("c003", 3, 1), ("c004", 3, 1)]


def test_text_clean_up(spark):
    assert one(spark, strip_accents, "Petición ÀÉñ ç й ø ß é") == "Peticion AEn c и ø ß e"
    assert one(spark, normalize_activity, "Petición A-1 (¿x=>y?): fin.") == "PeticionA_1xyfin"
    assert one(spark, simplify_name, "a b-c:complete") == "a_b_c"
    assert one(spark, simplify_name, "a\tb:start:COMPLETE") == "a_b__start"


@pytest.mark.parametrize("ms, text", [
    (5006, "5s 6ms"), (5000, "5s "), (60_000, "60s "), (245_000, "4m 5s"), (11_040_000, "3h 4m"),
    (183_600_000, "2d 3h"), (31_104_000_000, "360d "), (31_104_000_001, "0y 360d "),
    (31_719_600_000, "1y 2d 3h"), (31_536_000_000, "1y "),
])
def test_durations_for_people(spark, ms, text):
    assert spark.range(1).select(format_duration(F.lit(ms)).alias("t")).first()["t"] == text


def test_csv_with_quotes_empty_cells_and_accents(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('id,task,other\n1.2,"a,b",x\n2,Petición A-1,\n3,,y\n\n')
    log = read_csv_log(spark, str(path), ["id", "task"])
    assert log.columns == ["id", "task"]
    assert sorted(values(log, "id", "task")) == [("1.2", "a,b"), ("2", "Peticion A-1"), ("3", "-")]
    assert ("102", "a,b") in values(read_csv_log(spark, str(path), fix_case_dots=True), "id", "task")


def test_standardize_names_types_and_keeps_the_rest(spark):
    raw = spark.createDataFrame([("7", "Año-1", "2020/01/02 03:04:05", "red")], "id string, what string, at string, colour string")
    spec = LogSpec("id", "what", "at", "at")
    assert spec.instant
    row = cleaning.standardize(raw, spec).first()
    assert (row["trace"], row["activity"], row["timestamp"], row["timestampf"], row["colour"]) == (
        "7", "Ano_1", 1577934245000, 1577934245000, "red")


def test_typed_log_and_export(spark, make_log, tmp_path):
    log = make_log(("a", "X", 0, 61_000))
    export_csv(log, str(tmp_path / "out"))
    assert values(spark.read.csv(str(tmp_path / "out"), header=True),
                  "CaseIdentifier", "TaskIdentifier", "InitialTime", "CompleteTime") == [
        ("a", "X", "1970 01 01 00:00:00", "1970 01 01 00:01:01")]
    log.write.csv(str(tmp_path / "typed"), header=True)
    back = read_typed_log(spark, str(tmp_path / "typed"))
    assert dict(back.dtypes)["timestamp"] == "bigint" and values(back, "timestampf") == [(61_000,)]
    paths = save_tables({"events": log}, str(tmp_path / "result"))
    assert load_log(spark, paths["events"]).collect() == log.collect()


def test_xes_with_offsets_and_fractions(spark, tmp_path):
    def event(name, at):
        return (f'<event><string key="org:resource" value="r"/><string key="concept:name" value="{name}"/>'
                f'<date key="time:timestamp" value="{at}"/></event>')

    (tmp_path / "log.xes").write_text(
        '<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/">'
        '<trace><string key="concept:name" value="caso 1.5"/>' + event("A", "2020-01-01T01:00:00.250+01:00")
        + event("B", "2020-01-01T00:00:01Z") + '</trace>'
        '<trace><string key="concept:name" value="2.1"/>' + event("A", "2020-01-01T00:00:00.000Z") + "</trace></log>")
    rows = read_xes_log(spark, str(tmp_path / "log.xes")).withColumn("ms", F.unix_millis("completeTime"))
    assert sorted(values(rows, "case", "event", "ms")) == [
        ("2.1", "A", 1577836800000), ("caso 1.5", "A", 1577836800250), ("caso 1.5", "B", 1577836801000)]
    renamed = read_xes_log(spark, str(tmp_path / "log.xes"), rewrite_names=True)
    assert {r["case"].strip() for r in renamed.collect()} == {"15", "201"}


def test_mining_yields_tables_that_can_be_saved(spark, make_cases, tmp_path):
    tables = mine(make_cases(*["A B B C"] * 20, *["A C"] * 2, "A B"), group=True)
    paths = save_tables(tables, str(tmp_path / "mined"))
    rows = {name: load_log(spark, path).count() for name, path in paths.items()}
    assert rows["events"] == 20 * 5 + 2 * 4 + 4 and rows["traces"] == 23
    assert rows["edges"] == 4 and rows["nodes"] == 5 and rows["loops"] == 0
    assert rows["variant_frequency"] == 3 and rows["longest_shortest_case"] == 2
    assert all(rows[name] for name in rows if name != "loops")


def test_report_yields_tables_that_can_be_saved(spark, make_cases, tmp_path):
    log = make_cases("A B", "A", "B B").withColumns(
        {"w": F.when(F.col("trace") == "c001", "other").otherwise("main"), "c": F.col("trace")})
    paths = save_tables(report(log, "w", "c"), str(tmp_path / "report"))
    rows = {name: load_log(spark, path).count() for name, path in paths.items()}
    assert rows == {"cases": 3, "workflow_share": 2, "workflow_categories": 3, "workflow_durations": 2,
                    "workflow_category_matrix": 3, "bin_width": 1, "category_timeline": 3}


def test_events_without_activity_count_like_any_other(make_log):
    log = make_log((1, "A", 0, 1), (1, None, 2, 3), (1, "_START_", 4, 5))
    got = {r["activity"]: r["n"] for r in activity.activity_frequency(log).collect()}
    assert got == {"A": 1, None: 1}


def test_events_without_case_are_in_no_case(spark, make_log):
    log = make_log((1, "A", 0, 1)).unionByName(make_log((2, "A", 0, 1)).selectExpr(
        "cast(null as string) as trace", "activity", "timestamp", "timestampf", "event_seq"))
    assert sequence.case_count(log).first()["n_cases"] == 1
    assert sum(r["n"] for r in variants.variants(log).collect()) == 1


def test_means_of_sums_beyond_a_bigint(make_log):
    far = 2**62
    log = make_log((1, "A", 0, far), (1, "A", 0, far), (2, "A", 0, far))
    row = activity.activity_averages(log).select("mean", "max", "deviation").first()
    assert (row["mean"], row["max"], row["deviation"]) == (far, far, 0.0)


def test_times_that_can_not_be_read_are_told(spark):
    raw = spark.createDataFrame(
        [("1", "A", "2020/01/01 00:00:00", "-"), ("2", "B", "2020/01/01 00:00:00", "2020/01/01 00:00:01")],
        "c string, a string, s string, e string")
    spec = LogSpec(trace="c", activity="a", start="s", complete="e")
    assert [r["timestampf"] is None for r in cleaning.standardize(raw, spec).orderBy("trace").collect()] == [True, False]
    assert [r["c"] for r in cleaning.rejected(raw, spec).collect()] == ["1"]


def test_files_with_another_order_of_columns_are_not_mixed_up(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_log(spark, str(tmp_path)).collect()
