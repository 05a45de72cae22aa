"""Mining all slices at once gives what mining each alone gives."""

import pytest

from tracewright import mine
from tracewright.operators import arcs, branches, buckets, loops, model, patterns, variants
from tracewright.operators.activity import activity_frequency
from tracewright.operators.sequence import case_count
from tracewright.plans.storage import materialize
from tracewright.spec import ACTIVITY

LEVELS = [[{"k": [True]}, {"activity": ["A", "B", "C"]}], [{"s": branches.SPLIT}]]
SETTINGS = {"threshold": 0.3, "prune": [0.2, 0.6], "frequent": [0.2, 0.5], "infrequent": [0.5]}


@pytest.fixture(scope="module")
def log(spark):
    texts = ["A B C", "A B B D", "C", "A B C A", "B A", "B", "C C", "A C B D"]
    rows = [(f"c{i:03}", a, 10_000 * at, 10_000 * at + 1000, at, i % 2 == 0, "odd=1,x" if i % 3 else "e]")
            for i, text in enumerate(texts * 2) for at, a in enumerate(text.split())]
    return materialize(spark.createDataFrame(
        rows, "trace string, activity string, timestamp long, timestampf long, event_seq long, k boolean, s string"))


@pytest.fixture(scope="module")
def together(log):
    return mine(log, branches=LEVELS, group=[1], **SETTINGS)


PARTS = {
    "0": (None, False), "1.1": ("k", True), "1.2": ("k and activity in ('A', 'B', 'C')", True),
    "2.1[s=odd\\=1\\,x]": ("s = 'odd=1,x'", False), "2.1[s=e\\]]": ("s = 'e]'", False),
}


def lines(df, columns):
    return sorted(map(repr, df.select(columns).collect()))


@pytest.mark.parametrize("name", ["1.2"])
def test_every_table_of_a_slice(log, together, name):
    condition, group = PARTS[name]
    alone = mine(log.where(condition) if condition else log, group=group, **SETTINGS)
    assert set(together) == {"branches", *alone}
    for table, rows in alone.items():
        assert lines(together[table].where(together[table]["branch_id"] == name), rows.columns) == lines(rows, rows.columns), table


def test_slices_are_described_and_can_be_left_out(log, together):
    assert {r["branch_id"] for r in together["branches"].collect()} == set(PARTS)
    few = mine(log, branches=LEVELS, mined=[2], only_leaves=True)
    assert {r["branch_id"] for r in few["branches"].collect()} == {n for n in PARTS if n.startswith("2")}
    assert {r["branch_id"] for r in few["edges"].select("branch_id").distinct().collect()} == {n for n in PARTS if n.startswith("2")}
    with pytest.raises(ValueError, match="branches"):
        mine(log, mined=[0])


def test_values_with_the_signs_of_names_make_slices_of_their_own(spark):
    rows = [("t1", "A", 0, 0, 0, "x,b=y", "z"), ("t2", "A", 0, 0, 0, "x", "y,b=z")]
    log = spark.createDataFrame(rows, "trace string, activity string, timestamp long, timestampf long, event_seq long, a string, b string")
    levels = [[{"a": branches.SPLIT, "b": branches.SPLIT}]]
    assert branches.expand_branches(levels, log).where("level = 1").count() == 2
    counted = branches.run_branches(log, levels, activity_frequency).where("branch_id <> '0'").collect()
    assert sorted(r["n"] for r in counted) == [1, 1]


@pytest.mark.parametrize("op", [
    variants.top_variants, variants.variant_frequency, variants.variant_relative_frequency,
    variants.variant_frequency_with_cases, variants.variant_compliance,
    lambda log, keys=(): arcs.case_arcs(log, model.dependency_graph(log, 0.3, keys=keys), keys=keys),
    lambda log, keys=(): arcs.case_arcs(log, model.dependency_graph(log, 0.3, keys=keys), mode="directly_follows", keys=keys),
    lambda log, keys=(): loops.loops(model.dependency_graph(log, 0.3, keys=keys), keys),
    lambda log, keys=(): arcs.prune_arcs(arcs.directly_follows(log, keys), 0.5, keys),
    lambda log, keys=(): buckets.bounds_equal_width(arcs.directly_follows(log, keys), "frequency", keys=keys),
])
def test_operators_take_keys(log, op):
    whole = branches.run_branches(log, LEVELS, op)
    for name in ("1.1",):
        condition = PARTS[name][0]
        alone = op(log.where(condition) if condition else log)
        assert lines(whole.where(whole["branch_id"] == name), alone.columns) == lines(alone, alone.columns)


def test_patterns_take_keys(log):
    tagged = branches.tag_branches(log, LEVELS)
    keys = ["branch_id"]
    found = materialize(arcs.case_arcs(tagged, model.dependency_graph(tagged, 0.3, keys=keys), keys=keys))
    for kind in ("frequent", "infrequent"):
        whole = patterns.patterns_many(found, case_count(tagged, keys), [0.2, 0.5], kind, keys=keys)
        for name in ("1.1",):
            part = log.where(PARTS[name][0])
            alone = patterns.patterns_many(
                arcs.case_arcs(part, model.dependency_graph(part, 0.3)), case_count(part).first()["n_cases"], [0.2, 0.5], kind)
            assert lines(whole.where(whole["branch_id"] == name), alone.columns) == lines(alone, alone.columns)


def test_models_of_many_activities_give_the_same_arcs(log, monkeypatch):
    edges = materialize(model.dependency_graph(log, 0.3))
    few = arcs.case_arcs(log, edges)
    monkeypatch.setattr(arcs, "STATE", 2)
    many = arcs.case_arcs(log, edges)
    assert lines(few, few.columns) == lines(many, few.columns) and few.count()
    assert arcs.case_arcs(log, edges.where("false")).count() == 0
    assert ACTIVITY not in many.columns
