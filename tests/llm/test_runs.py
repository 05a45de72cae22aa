"""Periodic runs against brute force, and the query over looping documents."""

import hashlib
import random
import zlib

import __spark_entry__ as entry
import numpy as np
import pytest
from tracewright.llm import runs


def brute(words, min_words=24, min_periods=3):
    """(start, length, period) of all runs, period by period."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = np.array([numbers[w] for w in words])
    found = []
    for period in range(1, len(words) // min_periods + 1):
        same = np.r_[0, own[period:] == own[:-period], 0]
        edges = np.diff(same)
        for start, stop in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            length = stop - start + period
            if length >= max(min_words, min_periods * period):
                stretch = words[start:start + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, period)):
                    found.append((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_text(rnd):
    kind, n = rnd.random(), rnd.randint(0, 90)
    if kind < 0.4:
        return [rnd.choice("ab") for _ in range(n)]
    if kind < 0.5:
        return ["a"] * n
    if kind < 0.6:
        return [rnd.choice("abcdefghijkl") for _ in range(n)]
    words = []
    while len(words) < n:
        block = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
        words += block * rnd.randint(1, 8) + block[:rnd.randint(0, len(block))]
    return words


@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (6, 2)])
def test_runs_of_many_texts_are_those_of_brute_force(limits):
    rnd = random.Random(limits[0])
    texts = [some_text(rnd) for _ in range(400)]
    for at in range(0, len(texts), 7):
        got = runs.find([" \n".join(t) for t in texts[at:at + 7]], *limits)
        for text, (n, found, best, collapsed) in zip(texts[at:at + 7], got, strict=True):
            want = brute(text, *limits)
            dropped = {i for s, length, p in want for i in range(s + p, s + length)}
            assert (n, found) == (len(text), want)
            assert collapsed.decode() == " ".join(w for i, w in enumerate(text) if i not in dropped)
            assert best == min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)


def test_long_texts_of_few_words():
    every, third, wide = runs.find(
        ["a " * 60_000, "a b c " * 30_000, " ".join(str(i % 7000) for i in range(60_000))], 24, 3)
    assert [x[1] for x in (every, third, wide)] == [[(0, 60_000, 1)], [(0, 90_000, 3)], [(0, 60_000, 7000)]]
    assert [x[3] for x in (every, third)] == [b"a", b"a b c"]


def test_nulls_repeats_and_extra_columns(spark):
    text = "x " + "p q " * 20 + "y"
    docs = spark.createDataFrame(
        [(1, None, "r"), (2, "", "r"), (3, text, "r"), (3, text, "r"), (None, "a " * 24, None), (5, " \t\n", "s")],
        "doc_id long, text string, runs string")
    got = [
        (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"])
        for r in runs.periodic_runs(docs).collect()]
    looped = (3, 42, [(1, 40, 2)], (1, 40, 2), "x p q y")
    assert sorted(got, key=repr) == sorted([
        (1, 0, [], None, ""), (2, 0, [], None, ""), looped, looped, (None, 24, [(0, 24, 1)], (0, 24, 1), "a"),
        (5, 0, [], None, "")], key=repr)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in entry.queries()["op13_branching_tandem_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = brute(words)
        with_runs += bool(want)
        dropped = {i for s, length, q in want for i in range(s + q, s + length)}
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert tuple(got[doc_id]) == (
            doc_id, len(want), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())
    assert with_runs
