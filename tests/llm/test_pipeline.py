"""Every stage of the corpus pipeline on documents with odd rows, each held against brute force on its own input."""

import itertools
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

STAGES = dict(corpus_pipeline.STAGES)


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def groups(sets):
    """Number of the group of each set: linked from a similarity of 0.8 on, directly or over others."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(3).collect()]
    whole = next(r["text"] for r in docs.where("lang = 'en' and n_chars between 800 and 2000").orderBy("doc_id").collect())
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34 !!", "en", "s", 8), (9004, whole + " end.", "en", "s", 9),
           (9004, whole + " end.", "en", "s", 9), (9005, whole.split("\n")[0] + "\n" + items[0], "en", "s", 9), (None, whole[:700], "en", None, 1)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    found, rows = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        found[name] = (rows.collect(), after.collect(), rows.columns, after.columns)
        rows = after
    return found, items


def test_order_and_columns(stages):
    found, _ = stages
    assert list(found) == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert all(sorted(a) == sorted(b) for name, (_, _, a, b) in found.items() if name != "best-fit packing")


def test_documents_without_a_language_go(stages):
    before, after, *_ = stages[0]["language ID"]
    kept = {r["doc_id"] for r in after}
    assert not kept & {9001, 9002, 9003} and 9004 in kept
    letters = [r for r in before if r["lang"] and r["text"] and len(r["text"]) > 300]
    assert len(after) >= 0.95 * len(letters)


def test_no_line_is_left_twice(stages):
    before, after, *_ = stages[0]["line dedup"]
    lines = [line for r in after for line in r["text"].split("\n") if len(line) >= 32]
    assert len(lines) == len(set(lines))
    there = {line for r in before for line in r["text"].split("\n")}
    assert all(line in there for r in after for line in r["text"].split("\n"))


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after, *_ = stages[0]["MinHash near-dedup"]
    sets = [shingles(r["text"]) for r in before]
    assert len(after) == len(set(groups(sets)))
    left = [shingles(r["text"]) for r in after]
    assert len(set(groups(left))) == len(left)


def test_no_benchmark_passage_is_left(stages):
    found, _ = stages
    before, after, *_ = found["benchmark decontamination"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) >= 0.9 * len(before)


def test_every_document_is_packed(stages):
    before, after, *_ = stages[0]["best-fit packing"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after if r["piece"] == 0) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0) for r in before)
    places = {}
    for r in after:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1]
        assert sum(n for _, n in pieces) <= 4096


def test_windows_of_benchmark_items_are_gone(spark, sf_dir, stages):
    _, after, *_ = stages[0]["benchmark decontamination"]
    texts = [" " + " ".join(benchmark_words(r["text"])) + " " for r in after]
    for item in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = benchmark_words(item["text"])
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            window = " " + " ".join(words[i:i + size]) + " "
            assert not any(window in t for t in texts), window


def test_a_task_has_one_python_worker(spark, sf_dir):
    """Two of them a core would all keep what later stages load."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        text = stage(spark, docs, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("MapInArrow") <= 1, name
