"""The trained classifier: gradient, class weights, abstention, and the check of widths."""

import random

import numpy as np
import pytest
from feedloom.operators import classify as B


def corpus(n=400):
    rng = random.Random(6)
    own = {"food": ["recipe", "chef", "bread"], "art": ["museum", "novel", "film"], "tech": ["linux", "kernel", "browser"]}
    shared = ["today", "city", "people", "great", "small", "morning", "walk"]
    rows = []
    for i in range(n):
        label = "food" if i % 40 == 0 else "art" if i % 3 else "tech"  # food is rare
        rows.append((i, label, " ".join(rng.choice(own[label] if rng.random() < 0.3 else shared) for _ in range(12))))
    return rows


def test_rare_labels_are_learned_and_doubtful_texts_left_open(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, (1000, None, "x y"), (1001, "art", None)], "id long, label string, text string")
    model, history = B.fit(df, steps=25)
    assert model.labels == ["art", "food", "tech"] and max(history) > 0.9 and len(history) <= 25
    fresh = spark.createDataFrame([(i + 5000, t) for i, _, t in corpus(300)] + [(1, "today city"), (2, ""), (3, None)], "id long, text string")
    got = {r["id"]: (r["category"], r["probability"]) for r in B.classify(fresh, model, 0.5).collect()}
    assert len(got) == 303
    truth = {i + 5000: k for i, k, _ in corpus(300)}
    assert np.mean([got[i][0] == k for i, k in truth.items()]) > 0.9
    assert [got[i][0] for i, k in truth.items() if k == "food"].count("food") >= 6
    assert all(got[i][0] is None or got[i][1] >= 0.5 for i in got) and got[2] == got[3]
    sure = {r["id"]: r["category"] for r in B.classify(fresh, model, 0.9).collect()}
    assert sure[1] is None and 0 < sum(c is None for c in sure.values()) < 303
    again = B.Model.loads(model.dumps())
    assert {r["id"]: r["category"] for r in B.classify(fresh, again, 0.5).collect()} == {i: c for i, (c, _) in got.items()}


def test_models_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="do not fit"):
        B.Model(["a", "b"], {"x": 0}, np.ones(1), np.zeros((2, 3)))
    with pytest.raises(ValueError, match="two labels"):
        B.fit(spark.createDataFrame([(1, "a", "text")] * 20, "id long, label string, text string"))


def test_vectors_are_sublinear_and_of_unit_length():
    i, v = B._vector(["a", "a", "b", "zzz"], {"a": 0, "b": 1}, np.array([1.0, 2.0]))
    raw = np.array([1 + np.log(2), 2.0])
    assert list(i) == [0, 1] and v == pytest.approx(raw / np.linalg.norm(raw))
    assert len(B._vector([], {"a": 0}, np.ones(1))[0]) == 0
