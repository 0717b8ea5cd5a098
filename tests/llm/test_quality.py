from __future__ import annotations

import random

import numpy as np
import pytest

from salesops.llm import quality
from salesops.llm.queries import quality_classifier
from tests.llm.conftest import ODD


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    scores, grades = rng.normal(size=30), rng.integers(0, 4, 30)
    thresholds = np.array([-1.0, 0.2, 1.1])
    loss, by_score, by_threshold = quality.loss_and_gradient(scores, grades, thresholds)
    for i in range(30):
        moved = scores.copy()
        moved[i] += 1e-6
        assert (quality.loss_and_gradient(moved, grades, thresholds)[0] - loss) / 1e-6 == pytest.approx(by_score[i], abs=1e-4)
    for k in range(3):
        moved = thresholds.copy()
        moved[k] += 1e-6
        assert (quality.loss_and_gradient(scores, grades, moved)[0] - loss) / 1e-6 == pytest.approx(by_threshold[k], abs=1e-4)


def rated(n: int, seed: int) -> list[tuple]:
    """Grade 0 has two bad words, grade 1 one of them, grade 2 none."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"word{rng.randrange(60)}" for _ in range(rng.randint(30, 200))]
        grade = rng.randrange(3)
        for bad in rng.sample(["awful", "broken", "spoilt", "rotten"], 2 - grade):
            words.insert(rng.randrange(len(words)), bad)
        out.append((i, " ".join(words), grade))
    return out


def test_held_out_grades(spark):
    rows = rated(900, 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    train, held = frame.filter("doc_id < 600"), frame.filter("doc_id >= 600")
    model = quality.fit(train.drop("grade"), train.select("doc_id", "grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    again = quality.fit(train.drop("grade"), train.select("doc_id", "grade"), 3)
    assert np.allclose(model.weights, again.weights) and (model.hashes == again.hashes).all()
    expected = {r["doc_id"]: r["expected_grade"] for r in quality.score(held, model, 2).collect()}
    right = sum(round(expected[i]) == g for i, _, g in rows[600:])
    assert right / 300 > 0.95


def test_real_labels(spark, small, documents):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in quality_classifier(spark, small).collect()}
    assert len(rows) == documents.count()
    kept = [rows[d]["keep"] for d, label in labels.items() if label == (1, 0)]
    assert sum(kept) / len(kept) > 0.95
    assert all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows.values())


def test_selection_is_the_score(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(documents, quality.ratings_of(labels), quality.GRADES)
    good = {r["doc_id"] for r in quality.score(documents, model, 2).filter("p_good >= 0.5").collect()}
    assert {r["doc_id"] for r in quality.select_good(documents, model, 2).collect()} == good


def test_one_grade_or_none(spark, odd, no_docs):
    ratings = spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, grade int")
    for given, wanted in ((ratings, 0), (ratings.filter("grade > 5"), 2)):
        model = quality.fit(odd, given, 3)
        assert {round(r["expected_grade"]) for r in quality.score(odd, model, 2).collect()} == {wanted}


def test_odd_rows(spark, odd, no_docs):
    ratings = spark.createDataFrame([(1, 2), (5, 0), (6, 1), (None, 1), (3, None), (99, 1)], "doc_id long, grade int")
    model = quality.fit(odd, ratings, 3, quality.Fit(min_texts=1))
    rows = quality.score(odd, model, 2).collect()
    assert len(rows) == len(ODD)
    out = quality.select_good(odd, model, 2, 0.0)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert quality.score(no_docs, model, 2).count() == 0 and quality.select_good(no_docs, model, 2).count() == 0
    assert len(quality.fit(no_docs, ratings, 3).weights) == 0
