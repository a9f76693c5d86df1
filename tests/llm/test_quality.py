import random

import numpy as np

from tracelake.llm import quality


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    fine = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        words = rng.choices(fine, k=rng.randint(40, 90))
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(["awful", "nasty"])
        text = " ".join(words)
        rows.append((i, text.upper() + "!!!" if grade == 1 else text, grade))
    return rows


def test_grades_of_unseen_documents(spark):
    rows = corpus()
    rated = spark.createDataFrame([(t, g) for _, t, g in rows[:600]], "text string, grade int")
    model, top = quality.learn(rated)
    assert top == 2 and (np.diff(model.thresholds) > 0).all()
    out = quality.score(spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows[600:]], "doc_id long, text string, expected_grade double"), model, 2).collect()
    true = {i: g for i, _, g in rows}
    assert len(out) == 300
    right = sum(round(r["expected_grade"]) == true[r["doc_id"]] for r in out)
    assert right >= 0.9 * 300
    assert all(0 <= r["p_at_least_2"] <= r["p_at_least_1"] <= 1 and abs(r["expected_grade"] - r["p_at_least_1"] - r["p_at_least_2"]) < 1e-9 for r in out)
    assert sum(r["selected"] == (true[r["doc_id"]] == 2) for r in out) >= 0.9 * 300


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "w"), (3, "x " * 100_000), (3, "dup")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (9, 1, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.rate(docs, labels).collect()) == 5
    assert quality.rate(docs.limit(0), labels).collect() == []
    rows = quality.rate(docs, labels.limit(0)).collect()
    assert len(rows) == 5 and {r["p_at_least_1"] for r in rows} == {0.5}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_RATED", 50)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rated, top: seen.append(len(rated)))
    quality.learn(spark.createDataFrame([(t, g) for _, t, g in corpus()], "text string, grade int"))
    assert 20 < seen[0] < 90


def test_odd_columns(spark):
    docs = spark.createDataFrame([(1, "good text", 0, 1, "x"), (2, None, None, 0, None)], "doc_id long, text string, quality int, grade int, places string")
    labels = spark.createDataFrame([(1, 1, 0, "other"), (2, 0, 0, None)], "doc_id long, quality int, toxic int, text string")
    rows = quality.rate(docs, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2] and set(rows[0].asDict()) == {"doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "selected"}


def likelihood(weights, thresholds, rated):
    """Mean log-likelihood of dense rows (x, grade), less the penalty, by the plain formula."""
    total = 0.0
    for x, grade in rated:
        tails = [1.0, *(1 / (1 + np.exp(t - x @ weights)) for t in thresholds), 0.0]
        total += np.log(tails[grade] - tails[grade + 1])
    return total / len(rated) - quality.PENALTY / 2 * weights @ weights


def test_fit_finds_the_top_of_the_plain_likelihood(monkeypatch):
    """On few dimensions the fitted model can't be bettered by a step in any direction."""
    monkeypatch.setattr(quality, "DIMENSIONS", 4)
    monkeypatch.setattr(quality, "SHAPE", 2)
    monkeypatch.setattr(quality, "ROUNDS", 3000)
    monkeypatch.setattr(quality, "PENALTY", 0.05)
    monkeypatch.setattr(quality, "strengths", lambda at, row, grade, top: np.ones(6))
    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.5) * np.array([1, 1, 1, 1, 0.5, 0.25])
    score = x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0, -2.0]) + rng.logistic(size=400)
    grade = (score > 0).astype(int) + (score > 1.5)
    rated = [(int(g), np.arange(6).astype("<i4").tobytes(), r.astype("<f4").tobytes()) for g, r in zip(grade, x, strict=True)]
    model = quality.fit(rated, 2)
    plain = list(zip(x, grade, strict=True))
    weights, thresholds = model.weights.astype(float), model.thresholds
    best = likelihood(weights, thresholds, plain)
    for step in (0.05, -0.05):
        for i in range(6):
            assert likelihood(weights + step * np.eye(6)[i], thresholds, plain) < best
        for i in range(2):
            assert likelihood(weights, thresholds + step * np.eye(2)[i], plain) < best
