"""Arcs of cases and patterns against a direct search on small random logs."""

import itertools
import random

import pytest

from tracewright.operators import arcs, model, patterns, sequence
from tracewright.plans.storage import materialize
from tracewright.spec import END_TASK, START_TASK


def random_cases(seed, n=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("ABCD") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def sources(case, edges):
    """(source position, position, source, activity) by the definition, looking back from each event."""
    steps = [START_TASK, *case.split(), END_TASK]
    for j, activity in enumerate(steps):
        for src, dst in edges:
            before = [i for i in range(j) if steps[i] == src]
            if dst == activity and before and activity not in steps[before[-1] + 1:j]:
                yield before[-1], j, src, dst


def connected(arc_set):
    todo, seen = [next(iter(arc_set))], set()
    while todo:
        arc = todo.pop()
        if arc not in seen:
            seen.add(arc)
            todo += [b for b in arc_set if set(arc) & set(b)]
    return seen == set(arc_set)


@pytest.fixture(params=[1, 2], scope="module")
def mined(request, spark):
    texts = random_cases(request.param)
    log = spark.createDataFrame(
        [(f"c{i:03}", a, at, at, at) for i, text in enumerate(texts) for at, a in enumerate(text.split())],
        "trace string, activity string, timestamp long, timestampf long, event_seq long")
    found = materialize(model.dependency_graph(log, 0.2))
    edges = [tuple(r) for r in found.select("src", "dst").collect()]
    return texts, log, edges, materialize(arcs.case_arcs(log, found))


def test_arcs_of_cases(mined):
    texts, log, edges, found = mined
    expected = {}
    for text in texts:
        for _, _, src, dst in sources(text, edges):
            expected[src, dst] = expected.get((src, dst), 0) + 1
    got = {(r["src"], r["dst"]): r["frequency"] for r in arcs.arc_frequency(found).collect()}
    assert got == expected
    first = {r["variant_id"] for r in found.collect()}
    for name in first:
        case = texts[int(name[1:])]
        own = {(r["src_pos"], r["pos"], r["src"], r["dst"]) for r in found.collect() if r["variant_id"] == name}
        assert own == set(sources(case, edges))


@pytest.mark.parametrize("threshold", [0.15, 0.4])
def test_patterns(mined, threshold):
    texts, log, edges, found = mined
    held = [{(s, d) for _, _, s, d in sources(text, edges)} for text in texts]
    used = sorted(set().union(*held))
    support = {}
    for size in range(1, 9):
        for combo in itertools.combinations(used, size):
            count = sum(set(combo) <= own for own in held)
            if count and connected(combo):
                support[frozenset(combo)] = count / len(texts)
    frequent = {s for s, v in support.items() if v >= threshold}
    largest = {s for s in frequent if not any(s < t for t in frequent)}
    rare = {s for s, v in support.items() if v < threshold}
    smallest = {s for s in rare if not any(s - {a} in rare for a in s)}

    n = sequence.case_count(log).first()["n_cases"]

    def sets(df):
        rows = df.collect()
        assert all(abs(r["support"] - support[frozenset((a["src"], a["dst"]) for a in r["arcs"])]) < 1e-9 for r in rows)
        return {frozenset((a["src"], a["dst"]) for a in r["arcs"]) for r in rows}

    assert max(map(len, frequent), default=0) < 8, "the search above is cut at eight arcs"
    assert sets(patterns.frequent_patterns(found, n, threshold)) == largest
    assert sets(patterns.infrequent_patterns(found, n, threshold)) == smallest


def test_growth_can_be_limited(mined):
    _, log, _, found = mined
    n = sequence.case_count(log).first()["n_cases"]
    tried = patterns.grow_patterns(patterns.weighted_arc_sets(found), n, 0.05, max_arcs=2)
    assert {r["n_arcs"] for r in tried.collect()} == {1, 2}
