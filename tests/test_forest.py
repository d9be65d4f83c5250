"""Random forests over cells against trees grown row by row, and their native scores against the cells."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from raterscope.operators import classifiers, evaluation, forest, splits, validation
from raterscope.schemas import CORE_FEATURES
from raterscope.sources import models

COLUMNS = "user_id long, ai_label int, sd_rating double, kurtosis_rating double, skewness_rating double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 2, *map(float, rng.normal((i % 2) * 1.2, 1.0, 3))) for i in range(600)]
    return validation.prepare_folds(splits.balanced_folds(spark.createDataFrame(rows, COLUMNS), k=3))


def plain(bins, labels, depth):
    """A tree grown row by row with every feature tried at every node: nested (feature, cut, low, high) or a chance."""
    gini = lambda y: y.sum() * (len(y) - y.sum()) / len(y)
    best = (1e-9 * len(labels),)
    for f in range(bins.shape[1]) if depth else ():
        for cut in np.unique(bins[:, f])[:-1]:
            low = bins[:, f] <= cut
            gain = gini(labels) - gini(labels[low]) - gini(labels[~low])
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    if len(best) == 1:
        return labels.mean()
    _, f, cut = best
    low = bins[:, f] <= cut
    return f, cut, plain(bins[low], labels[low], depth - 1), plain(bins[~low], labels[~low], depth - 1)


def walk(tree, bins):
    while isinstance(tree, tuple):
        tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
    return tree


class Once:
    """Draws every row once and every feature first."""

    def poisson(self, counts):
        return counts

    def random(self, shape):
        return np.zeros(shape)


@pytest.mark.parametrize("depth", [3, 30])
def test_tree_equals_the_plain_version(depth):
    rng = np.random.default_rng(3)
    shape = (5, 1, 7)
    bins = np.stack([rng.integers(0, n, 5000) for n in shape], axis=1)
    labels = (rng.random(5000) < 0.15 + 0.7 * (bins[:, 0] * bins[:, 2] > 6)).astype(float)
    cells, inverse = np.unique(np.ravel_multi_index(bins.T, shape), return_inverse=True)
    counts = np.stack([np.bincount(inverse, labels == c, len(cells)) for c in (0, 1)], axis=1)
    at = np.stack(np.unravel_index(cells, shape), axis=1)
    chances, shares = forest._tree(at, counts, shape, depth, 3, Once())
    tree = plain(bins, labels, depth)
    for cell, chance in enumerate(chances):
        assert chance == pytest.approx(walk(tree, np.unravel_index(cell, shape)))
    assert shares.sum() == pytest.approx(1) and shares[1] == 0


def test_forest_is_as_good_as_sparks(spark, table):
    build = classifiers.random_forest(trees=20)
    own = validation.cross_validate(table, build, "own")
    theirs = validation.cross_validate(table, build.otherwise, "spark")
    areas = {r["model"]: r["mean_fold_auc"] for r in evaluation.mean_fold_auc(own.unionByName(theirs), ["model"]).collect()}
    assert areas["own"] > 0.8 and areas["own"] == pytest.approx(areas["spark"], abs=0.03)


def test_a_model_does_not_grow_with_its_rows(spark):
    """Four times the rows, all different: the grid and so the model stay as they are, and nothing of Spark's forest comes to the driver."""
    sizes = []
    for n in (20_000, 80_000):
        rows = spark.range(n).select(
            F.col("id").alias("user_id"),
            (F.col("id") % 2).cast("int").alias("ai_label"),
            *[(F.rand(i) + 0.3 * (F.col("id") % 2)).alias(f) for i, f in enumerate(CORE_FEATURES)],
        )
        model = validation.final_fit(validation.prepare_folds(splits.balanced_folds(rows, k=2)), classifiers.random_forest(trees=4))
        assert not isinstance(model, PipelineModel)
        sizes.append(len(model.chances))
    assert sizes == [32**3, 32**3]


def test_scores_partitions_and_round_trip(spark, table, tmp_path):
    build = classifiers.random_forest(trees=6)
    model = validation.final_fit(table, build)
    again = validation.final_fit(validation.FoldedTable(table.df.repartition(5).orderBy(F.rand(2)), table.fold_rows), build)
    assert again == model and sum(model.shares) == pytest.approx(1)
    points = [(0.1, -9.0, 9.0), (math.nan, 0.0, 1.0), (None, 0.0, 1.0), *[(c, c, c) for c in model.cuts[0][::7]]]
    df = spark.createDataFrame(points, "sd_rating double, kurtosis_rating double, skewness_rating double")
    for r in model.transform(df).collect():
        at = 0
        for f, cuts in zip(model.features, model.cuts):
            value = math.nan if r[f] is None else r[f]
            at = at * (len(cuts) + 1) + int(np.searchsorted(cuts, value, "right"))
        assert r["score"] == model.chances[at] and r["prediction"] == float(r["score"] > 0.5)
    assert models.load_model(models.save_model(model, str(tmp_path))) == model


def test_odd_tables(spark, table):
    """One row, one class, equal rows of both classes; and features too many for a grid."""
    for rows, chance in (([(1, 1, 0.0, 0.0, 0.0)], None), ([(i, 1, float(i), 0.0, 1.0) for i in range(9)], 1.0), ([(i, i % 2, 0.0, 0.0, 0.0) for i in range(8)], None)):
        df = spark.createDataFrame(rows, COLUMNS).withColumn("fold", F.lit(0))
        model = validation.final_fit(validation.prepare_folds(df), classifiers.random_forest(trees=10))
        scores = {r["score"] for r in model.transform(df).collect()}
        assert all(0.0 <= s <= 1.0 for s in scores) and len(scores) == 1
        assert chance is None or scores == {chance}
    wide = table.df.select("*", *[F.col("sd_rating").alias(f"f{i}") for i in range(5)])
    features = [f"f{i}" for i in range(5)]
    fitted = validation.fit_folds(validation.FoldedTable(wide, table.fold_rows), classifiers.random_forest(trees=2, depth=3), features)
    assert all(isinstance(m, PipelineModel) for m in fitted.values())
