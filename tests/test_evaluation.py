import math

import numpy as np
import pytest

from raterscope.operators import dataset, distributions
from raterscope.operators import evaluation as E


def brute_auc(rows):
    pos = [s for label, s in rows if label == 1]
    neg = [s for label, s in rows if label == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i % 3, int(label), float(round(rng.normal(label, 1.0), 1)), 0.0)
        for i, label in enumerate(rng.integers(0, 2, 600))
    ]
    rows = [(f, label, s, float(s > 0.5)) for f, label, s, _ in rows]
    return spark.createDataFrame(rows, "fold int, label int, score double, prediction double").cache()


def test_auc_per_fold_mean_and_pooled(scored):
    rows = [(r["fold"], r["label"], r["score"]) for r in scored.collect()]
    want = {f: brute_auc([(y, s) for g, y, s in rows if g == f]) for f in range(3)}
    got = {r["fold"]: r["auc"] for r in E.roc_auc(scored).collect()}
    assert got == pytest.approx(want)
    assert E.mean_fold_auc(scored).first()["mean_fold_auc"] == pytest.approx(np.mean(list(want.values())))
    assert E.pooled_auc(scored).first()["pooled_auc"] == pytest.approx(brute_auc([(y, s) for _, y, s in rows]))


def test_tied_scores_and_single_class(spark):
    tied = spark.createDataFrame([(0, y, 0.5) for y in (0, 1, 1)], "fold int, label int, score double")
    assert E.roc_auc(tied).first()["auc"] == 0.5
    single = spark.createDataFrame([(0, 1, 0.5)], "fold int, label int, score double")
    assert E.roc_auc(single).first()["auc"] is None


def test_roc_is_monotone_and_its_area_is_the_auc(scored):
    points = sorted((r["fpr"], r["tpr"]) for r in E.roc_points(scored).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(E.pooled_auc(scored).first()["pooled_auc"])


def test_confusion_and_report(scored):
    rows = [(r["label"], int(r["prediction"])) for r in scored.collect()]
    cells = {(r["label"], r["prediction"]): r["n"] for r in E.confusion_matrix(scored).collect()}
    assert cells == {(t, p): rows.count((t, p)) for t in (0, 1) for p in (0, 1)}
    report = {r["class"]: r for r in E.classification_report(scored, []).collect()}
    precision = cells[1, 1] / (cells[1, 1] + cells[0, 1])
    recall = cells[1, 1] / (cells[1, 1] + cells[1, 0])
    assert report["1"]["precision"] == pytest.approx(precision)
    assert report["1"]["recall"] == pytest.approx(recall)
    assert report["1"]["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
    assert report["accuracy"]["f1"] == pytest.approx((cells[1, 1] + cells[0, 0]) / len(rows))
    assert report["macro avg"]["recall"] == pytest.approx((report["0"]["recall"] + recall) / 2)
    weighted = (report["0"]["recall"] * report["0"]["support"] + recall * report["1"]["support"]) / len(rows)
    assert report["weighted avg"]["recall"] == pytest.approx(weighted)


def test_average_report_sums_support(scored):
    folds = E.classification_report(scored).collect()
    average = {r["class"]: r for r in E.average_report(scored).collect()}
    for name, row in average.items():
        mine = [r for r in folds if r["class"] == name]
        assert len(mine) == 3 and row["support"] == sum(r["support"] for r in mine)
        assert row["precision"] == pytest.approx(np.mean([r["precision"] for r in mine]))


def test_nothing_predicted_positive(spark):
    rows = spark.createDataFrame([(0, 1, 0.0), (0, 0, 0.0)], "fold int, label int, prediction double")
    report = {r["class"]: r for r in E.classification_report(rows).collect()}
    assert report["1"]["precision"] == 0 and report["1"]["recall"] == 0 and report["1"]["f1"] == 0


def test_integer_histogram(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (5.0,), (None,), (float("nan"),)], "rating double")
    assert {r["bin"]: r["n"] for r in distributions.integer_histogram(df).collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 1}
    top = spark.createDataFrame([(1.0,), (2.5,)], "rating double")
    assert {r["bin"]: r["n"] for r in distributions.integer_histogram(top).collect()} == {1: 1, 2: 1, 3: 0}
    assert distributions.integer_histogram(df.filter("false")).count() == 0


def test_first_user_histogram_skips_users_without_ratings(ratings):
    table = ratings({1: [None], 2: [3, 3, 4], 5: [1]})
    assert {r["bin"]: r["n"] for r in distributions.first_user_histogram(table).collect()} == {3: 2, 4: 1}


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 2), float(rng.normal(i % 2, 1)), 2.0 if i % 2 else float(rng.integers(1, 4))) for i in range(300)]
    return spark.createDataFrame(rows, "ai_label int, a double, b double").cache()


def test_feature_histogram_equals_numpy(features):
    rows = distributions.feature_histogram(features, ["a", "b"]).collect()
    table = features.toPandas()
    assert len(rows) == 2 * 2 * 30
    for feature in ("a", "b"):
        for label in (0, 1):
            values = table.loc[table.ai_label == label, feature]
            counts, edges = np.histogram(values, bins=30)
            mine = sorted((r for r in rows if r["feature"] == feature and r["ai_label"] == label), key=lambda r: r["bin"])
            assert [r["n"] for r in mine] == list(counts)
            assert [r["bin_start"] for r in mine] == pytest.approx(list(edges[:-1]))


def test_density_equals_direct_sum(features):
    rows = distributions.feature_density(features, ["a", "b"]).collect()
    values = features.filter("ai_label = 0").toPandas()["a"].to_numpy()
    h = values.std(ddof=1) * len(values) ** -0.2
    mine = sorted((r for r in rows if r["feature"] == "a" and r["ai_label"] == 0), key=lambda r: r["point"])
    assert len(mine) == 200
    for row in mine[::37]:
        want = np.exp(-0.5 * ((row["x"] - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert row["density"] == pytest.approx(want)
        assert row["scaled"] == pytest.approx(want * len(values) * np.ptp(values) / 30)
    constant = [r for r in rows if r["feature"] == "b" and r["ai_label"] == 1]
    assert len(constant) == 1 and constant[0]["density"] is None


def test_density_is_zero_between_far_clusters(spark):
    rng = np.random.default_rng(3)
    values = np.append(rng.uniform(0, 1, 2000), 100.0)
    df = spark.createDataFrame([(0, float(v)) for v in values], "ai_label int, a double")
    rows = sorted(distributions.feature_density(df, ["a"]).collect(), key=lambda r: r["point"])
    h = values.std(ddof=1) * len(values) ** -0.2
    assert np.diff(np.sort(values)).max() > 78 * h
    assert len(rows) == 200
    for row in rows:
        want = np.exp(-0.5 * ((row["x"] - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert row["density"] == pytest.approx(want)
        assert row["scaled"] == pytest.approx(want * len(values) * np.ptp(values) / 30)
    assert 0.0 in [r["density"] for r in rows]


def test_variance_inflation(spark):
    rng = np.random.default_rng(1)
    a, b, d, noise = rng.normal(size=(4, 200))
    table = np.column_stack([a, b, a + 0.5 * b + 0.1 * noise, d])
    df = spark.createDataFrame(table.tolist(), "a double, b double, c double, d double")
    for names in (["a", "b", "c"], ["a", "b", "c", "d"], ["a", "d"]):
        matrix = np.corrcoef(table[:, ["abcd".index(n) for n in names]], rowvar=False)
        want = dict(zip(names, np.diag(np.linalg.inv(matrix))))
        got = {r["feature"]: r["vif"] for r in dataset.variance_inflation(df, names).collect()}
        assert got == pytest.approx(want)
    collinear = df.selectExpr("a", "b", "a + b AS c", "d")
    for names in (["a", "b", "c"], ["a", "b", "c", "d"]):
        assert {r["vif"] for r in dataset.variance_inflation(collinear, names).collect()} == {None}
    pairs = {(r["feature_a"], r["feature_b"]): r["corr"] for r in dataset.correlation_pairs(df, ["a", "b"]).collect()}
    assert pairs == pytest.approx({("a", "b"): np.corrcoef(a, b)[0, 1]})


def test_dataset_by_name_and_bad_ids(spark):
    from raterscope.schemas import DATASET_COLUMNS, STATISTICS, USER_STATISTICS

    human = spark.createDataFrame([(i, *map(float, range(10))) for i in (1, 10**18, None)], USER_STATISTICS)
    machine = spark.createDataFrame([(1, *map(float, range(10)))], USER_STATISTICS)
    swapped = machine.select("user_id", *reversed(STATISTICS))
    both = dataset.labelled_dataset(human, swapped, n_human=None)
    assert tuple(both.columns) == DATASET_COLUMNS
    rows = {r["user_id"]: r for r in both.collect()}
    assert set(rows) == {10, 11} and rows[10]["ai_label"] == 0 and rows[11]["ai_label"] == 1
    assert all(rows[10][s] == rows[11][s] for s in STATISTICS)
    assert dataset.rejected_ids(human, 0).first()["rejected"] == 2
    assert dataset.rejected_ids(spark.createDataFrame([("12.0",), ("7",)], "user_id string"), 1).first()["rejected"] == 1
