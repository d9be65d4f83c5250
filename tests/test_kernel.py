"""Kernel support vectors against plain Newton steps, on rings, and their probabilities."""

import math

import numpy as np
import pytest

from raterscope.operators import evaluation, splits, validation
from raterscope.operators.kernel import KernelModel, KernelSvm
from raterscope.schemas import CORE_FEATURES
from raterscope.sources import models

SCHEMA = "user_id long, ai_label int, sd_rating double, kurtosis_rating double, skewness_rating double"


@pytest.fixture(scope="module")
def rings(spark):
    """Two rings around one centre: no line, plane or mean parts them."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(360):
        turn, far = rng.uniform(0, 2 * math.pi), (1.0 if i % 2 else 2.2) + rng.normal(0, 0.12)
        rows.append((i, i % 2, far * math.cos(turn), 5 + 10 * far * math.sin(turn), float(rng.normal(0, 0.3))))
    return validation.prepare_folds(splits.balanced_folds(spark.createDataFrame(rows, SCHEMA), k=3))


@pytest.fixture(scope="module")
def fitted(rings):
    return validation.fit_folds(rings, KernelSvm())


def test_rings_are_parted(rings, fitted):
    scored = validation.out_of_fold(rings, fitted, "m").cache()
    assert scored.count() == 360 and scored.filter("score <= 0 or score >= 1").count() == 0
    assert all(r["auc"] > 0.97 for r in evaluation.roc_auc(scored, ["fold"]).collect())
    rows = scored.collect()
    assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.95
    # Of the rows that score about p, a share of about p is of class 1.
    for low, high in ((0.0, 0.2), (0.8, 1.0)):
        band = [r for r in rows if low <= r["score"] <= high]
        assert abs(np.mean([r["label"] for r in band]) - np.mean([r["score"] for r in band])) < 0.1


def arrays(rows):
    return np.array([[r[f] for f in CORE_FEATURES] for r in rows]), np.array([r["ai_label"] for r in rows])


def test_same_as_plain(rings, fitted):
    """Weights by Newton steps on all rows at once; the sigmoid is the stationary point of its loss."""
    rows, svm = rings.df.collect(), KernelSvm()
    frequencies, phases = svm.cosines(3)
    for fold, model in fitted.items():
        x, y = arrays([r for r in rows if r["fold"] != fold])
        mean, sd, sign = x.mean(axis=0), x.std(axis=0), 2.0 * y - 1
        phi = lambda v: np.c_[np.sqrt(2 / len(phases)) * np.cos((v - mean) / sd @ frequencies.T + phases), np.ones(len(v))]
        a, w = phi(x), np.zeros(len(phases) + 1)
        ridge = np.r_[np.ones(len(phases)), 1e-9]
        for _ in range(40):
            gap = 1 - sign * (a @ w)
            on = gap > 0
            grad = ridge * w - 2 * (sign[on] * gap[on]) @ a[on]
            w -= np.linalg.solve(np.diag(ridge) + 2 * a[on].T @ a[on], grad)
        assert np.abs(grad).max() < 1e-8
        assert list(model.weights) + [model.bias] == pytest.approx(w, abs=1e-6)
        seen = rings.df.filter(f"fold = {fold}").sort("user_id")
        shown = model.transform(seen.withColumn("margin", model.margin())).collect()
        margins = phi(arrays(shown)[0]) @ w
        assert [r["margin"] for r in shown] == pytest.approx(margins, abs=1e-5)
        assert [r["score"] for r in shown] == pytest.approx(1 / (1 + np.exp(model.slope * margins + model.shift)), abs=1e-5)
        assert model.slope < 0


def test_native_plan_and_round_trip(spark, rings, fitted, tmp_path):
    plan = fitted[0].transform(rings.df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    path = models.save_model(fitted[0], str(tmp_path))
    assert models.load_model(path) == fitted[0] and isinstance(fitted[0], KernelModel)


def test_one_class_and_constant_features(spark):
    rows = spark.createDataFrame([(1.0, 2.0, -1)] * 9, "label double, sd_rating double, held_out int")
    model = KernelSvm(steps=5, components=8).fit_together(rows, ["sd_rating"], [-1, 4], 9)
    assert model[-1].transform(rows).first()["score"] > 0.5
    assert 0 < model[4].transform(rows).first()["score"] < 1
