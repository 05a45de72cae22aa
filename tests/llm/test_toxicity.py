"""The label model on votes of known rates, held-out accuracy, and odd tables."""

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewright.llm import toxicity


def drawn(rates, n, prior, seed, copies=()):
    """Votes of n texts by voters with (toxic, other) rates; `copies` are (voter, voter) that vote alike."""
    rnd = np.random.default_rng(seed)
    label = rnd.random(n) < prior
    chance = np.where(label[:, None], [r[0] for r in rates], [r[1] for r in rates])
    votes = (rnd.random(chance.shape) < chance).astype(int)
    for a, b in copies:
        votes[:, b] = np.where(rnd.random(n) < 0.95, votes[:, a], votes[:, b])
    return votes, label


def test_rates_are_found_without_labels():
    rates = [(0.6, 0.01), (0.4, 0.02), (0.8, 0.1), (0.3, 0.001), (0.5, 0.05), (0.2, 0.2), (0.0, 0.0)]
    votes, label = drawn(rates, 200_000, 0.15, 1)
    model = toxicity.fit_label_model(votes.T @ votes, len(votes), 0.15)
    assert np.allclose(model.toxic[:6], [r[0] for r in rates[:6]], atol=0.03)
    assert np.allclose(model.other[:6], [r[1] for r in rates[:6]], atol=0.01)
    assert model.toxic[6] == model.other[6]  # a voter that never fires says nothing
    guess = model.posterior(votes) > 0.5
    true = np.log(0.15 / 0.85) + sum(
        np.where(votes[:, i], np.log(a / b), np.log((1 - a) / (1 - b))) for i, (a, b) in enumerate(rates[:6])) > 0
    assert (guess == true).mean() > 0.99


def test_voters_that_copy_each_other_share_their_say():
    rates = [(0.5, 0.05)] * 6
    votes, label = drawn(rates, 200_000, 0.2, 2, copies=[(0, 1), (0, 2)])
    model = toxicity.fit_label_model(votes.T @ votes, len(votes), 0.2)
    fires, _, _ = model.evidence()
    assert np.abs(model.correlation[0, 1:3]).min() > 0.5 and np.abs(model.correlation[3:, 3:] - np.eye(3)).max() < 0.1
    assert fires[:3].sum() < 1.5 * fires[3:].mean()
    assert np.allclose(model.toxic, 0.5, atol=0.05)


def test_regression_meets_its_labels():
    rows = [([], [], 0.02, 9000), ([0], [1.0], 0.97, 500), ([1], [1.0], 0.1, 400)]
    weights = toxicity.fit_linear(rows, 2)
    score = [1 / (1 + np.exp(-(weights[-1] + sum(weights[c] * v for c, v in zip(r[0], r[1], strict=True))))) for r in rows]
    assert np.allclose(score, [r[2] for r in rows], atol=0.06)
    assert toxicity.fit_linear([], 2)[-1] < 0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_accuracy_of_the_query(spark, sf):
    got = entry.queries()["op11_weak_supervision"](spark, f"/root/testdata/{sf}")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("held_out").select(
        "toxic", "predicted", "score").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(hit) > 0.85 * len(hit) and sum(clean) < 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def sample_docs(spark, parts):
    texts = [(i, ("good morning friend %d " % i + ("blorkhead zanfool " if i % 5 == 0 else "")) * (1 + i % 3)) for i in range(400)]
    docs = spark.createDataFrame(texts + [(1000, None), (1001, ""), (None, "blorkhead"), (5, texts[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(300)] + [(5, 0), (7, None), (None, 1), (2000, 1), (9, 3)], "doc_id long, label int")
    return docs.repartition(parts), labels.repartition(parts)


def test_odd_rows_and_layout(spark):
    found = []
    for parts in (1, 7):
        docs, labels = sample_docs(spark, parts)
        model = toxicity.train(docs, labels)
        assert {"blorkhead", "zanfool"} <= set(model.lexicon)
        clashing = docs.withColumn("score", F.lit("s")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
        scored = toxicity.predict(clashing, model)
        assert scored.columns == ["doc_id", "text", "m", "score", "predicted"]
        found.append({(r["doc_id"], r["text"]): r["score"] for r in scored.collect()})
        assert scored.where("doc_id = 5").select("score").distinct().count() == 1
    assert found[0] == pytest.approx(found[1], abs=1e-9)
    assert found[0][1000, None] == found[0][1001, ""] < 0.1
    assert found[0][None, "blorkhead"] > 0.2 and found[0][350, sample_docs(spark, 1)[0].where("doc_id = 350").first()["text"]] > 0.7


def test_no_rows_and_no_labels(spark):
    docs, labels = sample_docs(spark, 1)
    unlabelled = toxicity.train(docs, labels.where("false"))
    assert unlabelled.lexicon == {}
    assert toxicity.predict(docs, unlabelled).where("predicted = 1").count() == 0
    empty = toxicity.train(docs.where("false"), labels)
    assert toxicity.predict(docs.where("false"), empty).count() == 0
