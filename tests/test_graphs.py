"""Loops and patterns on graphs: components, closures, reuse of what was grown."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import activity, arcs, loops, model, patterns, sequence, variants
from tracewright.plans.ranks import numbered
from tracewright.spec import START_TASK


def distances(graph):
    depth, edge = {START_TASK: 0}, [START_TASK]
    while edge:
        edge = sorted({b for n in edge for a, b in graph if a == n} - set(depth))
        depth |= {b: max(depth.values()) + 1 for b in edge}
    return depth


@pytest.fixture(scope="module")
def graphs(spark):
    rnd = random.Random(4)
    rows, expected = [], []
    for k in range(10):
        names = [START_TASK, *"ABCDEFGHIJ"[: rnd.randint(2, 10)]]
        graph = sorted({(rnd.choice(names), rnd.choice(names[1:])) for _ in range(rnd.randint(1, 18))})
        rows += [(str(k), *arc) for arc in graph]
        nodes = {n for arc in graph for n in arc}
        reach = {n: {b for a, b in graph if a == n} for n in nodes}
        for _ in nodes:
            reach = {n: reach[n].union(*[reach[m] for m in reach[n]]) for n in nodes}
        depth = distances(graph)
        place = {n: (depth.get(n, 10**9), n) for n in nodes}
        expected += [(str(k), "self", a, b) for a, b in graph if a == b]
        expected += [(str(k), "return", a, b) for a, b in graph if a != b and a in reach[b] and place[b] < place[a]]
    chain = [f"n{i:02}" for i in range(25)]
    rows += [("chain", a, b) for a, b in zip(chain, chain[1:])] + [("chain", "n24", "n10")]
    return spark.createDataFrame(rows, "k string, src string, dst string"), sorted([*expected, ("chain", "return", "n24", "n10")])


@pytest.mark.parametrize("pairwise", [2000, 0])
def test_loops_of_random_graphs(graphs, monkeypatch, pairwise):
    monkeypatch.setattr(loops, "PAIRWISE", pairwise)
    frame, expected = graphs
    assert sorted(tuple(r) for r in loops.loops(frame, ["k"]).collect()) == expected


def test_activities_that_start_reaches_alike_can_loop(spark):
    frame = spark.createDataFrame([(START_TASK, "A"), (START_TASK, "B"), ("A", "B"), ("B", "A")], "src string, dst string")
    assert [tuple(r) for r in loops.loops(frame).collect()] == [("return", "B", "A")]
    assert loops.loops(frame.where("false")).count() == 0


def arc_rows(spark, sets):
    """A table of arcs of cases from (arcs, cases) pairs."""
    return spark.createDataFrame(
        [(f"v{i}", n, 0, at, *arc) for i, (held, n) in enumerate(sets) for at, arc in enumerate(held)],
        "variant_id string, reps long, src_pos long, pos long, src string, dst string")


HUB = [("h", f"x{i:02}") for i in range(25)]


def test_a_hub_of_arcs_that_come_together_takes_few_rounds(spark):
    tail = [("x03", "y"), ("y", "z")]
    found = arc_rows(spark, [(HUB, 50), (HUB + tail, 30), (tail, 20)])
    rounds = []
    original = patterns.Sets.counted
    try:
        patterns.Sets.counted = lambda self, *a: rounds.append(1) or original(self, *a)
        frequent = patterns.frequent_patterns(found, 100, 0.4).collect()
        assert len(rounds) <= 4
        rounds.clear()
        rare = patterns.infrequent_patterns(found, 100, 0.4).collect()
        assert len(rounds) <= 5
    finally:
        patterns.Sets.counted = original
    assert sorted((len(r["arcs"]), r["support"]) for r in frequent) == [(2, 0.5), (25, 0.8)]
    # an arc of the hub and one of the tail: 0.3; x03 -> y hangs on to h -> x03 and to every other arc of the hub through it
    got = {tuple(sorted(tuple(a) for a in r["arcs"])) for r in rare}
    assert got == {(("h", "x03"), ("x03", "y"))} and all(r["support"] == 0.3 for r in rare)


def test_no_frequent_arc(spark):
    found = arc_rows(spark, [([("a", "b")], 1), ([("c", "d")], 1)])
    assert patterns.frequent_patterns(found, 10, 0.5).count() == 0
    assert sorted(r["support"] for r in patterns.infrequent_patterns(found, 10, 0.5).collect()) == [0.1, 0.1]
    assert patterns.frequent_patterns(found.where("false"), 10, 0.5).count() == 0


@pytest.mark.parametrize("kind", ["frequent", "infrequent"])
def test_stored_candidates_are_read_again(spark, tmp_path, monkeypatch, kind):
    rnd = random.Random(2)
    every = [(a, b) for a in "abc" for b in "bcd"]
    found = arc_rows(spark, [(sorted(rnd.sample(every, rnd.randint(2, 7))), rnd.randint(1, 9)) for _ in range(12)])
    total = 60
    path = str(tmp_path / "patterns")

    def same(thresholds):
        kept = patterns.stored_patterns(path, found, total, thresholds, kind)
        new = patterns.patterns_many(found, total, thresholds, kind)
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, new.collect()))

    same([0.3, 0.5])
    grown = []
    original = patterns.candidates
    monkeypatch.setattr(patterns, "candidates", lambda *a: grown.append(1) or original(*a))
    patterns.stored_patterns(path, found, total, [0.35, 0.45], kind).collect()
    assert not grown  # between what is there
    patterns.stored_patterns(path, found, total, [0.2], kind).collect()
    assert len(grown) == 1
    patterns.stored_patterns(path, found, total, [0.2, 0.5], kind).collect()
    assert len(grown) == 1
    same([0.2, 0.25])


def test_patterns_are_numbered_from_the_most_frequent_one(spark):
    rows = [(0.1, [("a", "b")], 0.5), (0.1, [("a", "c")], 0.9), (0.1, [("a", "a")], 0.5), (0.3, [("a", "c")], 0.9)]
    frame = spark.createDataFrame(rows, "threshold double, arcs array<struct<src:string,dst:string>>, support double")
    got = {(r["threshold"], r["pattern"]): r["name"] for r in patterns.pattern_summary(frame).collect()}
    assert got == {(0.1, "a->c"): "Pattern 1", (0.1, "a->a"): "Pattern 2", (0.1, "a->b"): "Pattern 3", (0.3, "a->c"): "Pattern 1"}


def test_numbers_over_many_partitions(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("v"))
    got = numbered(frame, [F.desc("v")], "i", by=["g"]).collect()
    for g in range(3):
        own = sorted((r["v"] for r in got if r["g"] == g), reverse=True)
        assert [r["v"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])] == own
        assert sorted(r["i"] for r in got if r["g"] == g) == list(range(1, len(own) + 1))


def test_events_without_a_case_are_in_no_case_anywhere(spark):
    log = spark.createDataFrame(
        [("c", "A", 0, 1, 0), (None, "A", 0, 1, 1), (None, "B", 2, 3, 2), ("d", "A", 0, 1, 3)],
        "trace string, activity string, timestamp long, timestampf long, event_seq long")
    assert sequence.traces(log).count() == sequence.case_count(log).first()["n_cases"] == 2
    assert arcs.directly_follows(log).count() == 0 and arcs.arc_duration_stats(log).count() == 0
    found = {(r["src"], r["dst"]): r["frequency"] for r in model.dependency_graph(log).collect()}
    assert found == {("_START_", "A"): 2, ("A", "_END_"): 2}
    assert {r["activity"]: r["frequency"] for r in model.discover(log)["nodes"].collect()} == {"_START_": 2, "A": 2, "_END_": 2}
    assert sum(r["n"] for r in variants.variants(log).collect()) == 2


def test_an_event_without_activity_has_arcs(make_log):
    log = make_log((1, "A", 0, 1), (1, None, 2, 3), (1, "B", 4, 5))
    follows = {(r["src"], r["dst"]) for r in arcs.directly_follows(log).collect()}
    edges = model.dependency_graph(log, 0.1)
    assert follows == {("A", "-"), ("-", "B")}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == follows | {("_START_", "A"), ("B", "_END_")}
    assert {(r["src"], r["dst"]) for r in arcs.case_arcs(log, edges).collect()} == follows | {("_START_", "A"), ("B", "_END_")}


def test_totals_beyond_a_bigint(make_log):
    far = 2**62
    log = make_log((1, "A", 0, far), (1, "A", 0, far), (2, "A", 0, far), (2, "B", 0, far))
    rows = {r["activity"]: (r["mean"], r["total"], r["median"]) for r in activity.activity_durations(log).collect()}
    assert rows == {"A": (far, None, far), "B": (far, far, far)}
    ends = {r["kind"]: r["activity"] for r in activity.longest_shortest_activity(log).collect()}
    assert ends == {"longest": "A", "shortest": "B"}
    assert activity.activity_averages(log).count() == 2


def test_events_of_one_start_go_by_completion_then_name(make_log):
    log = make_log((1, "B", 0, 5), (1, "C", 0, 5), (1, "A", 0, 9), (1, "D", 0, 1)).withColumn("event_seq", F.lit(0).cast("long"))
    assert [r["activity"] for r in sequence.sequence(log).orderBy("pos").collect()] == ["D", "B", "C", "A"]
