"""Boosted trees against a plain recursive version, and their native scores against a walk of the nodes."""

import contextlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterscope.operators import boosting, splits, validation
from raterscope.operators.boosting import BoostedModel, BoostedTrees
from raterscope.plans import catalog
from raterscope.schemas import CORE_FEATURES

DATA = "/root/testdata/sf0.01"


def plain(x, y, cuts, p, n_rows):
    """Trees as nested tuples (feature, cut, gain, left, right) or a value; sums of derivatives rounded as the table's size asks."""
    scale = 2.0 ** (52 - int(n_rows).bit_length())
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0.0), g)
    worth = lambda g, h: soft(g) ** 2 / (h + p.l2)
    margin, trees = np.zeros(len(x)), []
    for _ in range(p.rounds):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = np.rint((chance - y) * scale) / scale, np.rint(np.maximum(chance * (1 - chance), 1e-16) * scale) / scale

        def grow(rows, depth):
            g, h = slope[rows].sum(), curve[rows].sum()
            best = (1e-6,)
            for f in range(x.shape[1]) if depth < p.depth else ():
                for cut in cuts[f]:
                    low = rows & (x[:, f] < cut)
                    gl, hl = slope[low].sum(), curve[low].sum()
                    if hl >= p.least_cover and h - hl >= p.least_cover:
                        gain = worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)
                        if gain > best[0]:
                            best = (gain, f, cut)
            if len(best) == 1:
                return -p.rate * soft(g) / (h + p.l2)
            gain, f, cut = best
            low = x[:, f] < cut
            return f, cut, gain, grow(rows & low, depth + 1), grow(rows & ~low, depth + 1)

        tree = grow(np.ones(len(x), bool), 0)
        trees.append(tree)
        margin += np.array([walk(tree, row) for row in x])
    return trees


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] < tree[1] else tree[4]
    return tree


def gains(tree, found):
    if isinstance(tree, tuple):
        found[tree[0]].append(tree[2])
        gains(tree[3], found)
        gains(tree[4], found)
    return found


def shares(trees, n):
    found = [[] for _ in range(n)]
    for tree in trees:
        gains(tree, found)
    means = [sum(g) / len(g) if g else 0.0 for g in found]
    return [m / sum(means) for m in means]


def probability(trees, row):
    return 1 / (1 + math.exp(-sum(walk(t, row) for t in trees)))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, *map(float, rng.normal((i % 2) * 0.8, 1.0, 3).round(1))) for i in range(150)]
    schema = "user_id long, ai_label int, sd_rating double, kurtosis_rating double, skewness_rating double"
    return validation.prepare_folds(splits.balanced_folds(spark.createDataFrame(rows, schema), k=3))


P = BoostedTrees(rounds=13, depth=4)


def arrays(rows):
    return np.array([[r[f] for f in CORE_FEATURES] for r in rows]), np.array([float(r["label"]) for r in rows])


def test_folds_equal_the_plain_version(spark, table):
    rows = table.df.withColumnRenamed("ai_label", "label").collect()
    cuts = P.cut_points(table.df, CORE_FEATURES)
    assert all(set(c) <= set(arrays(rows)[0][:, f]) for f, c in enumerate(cuts))
    fitted = validation.fit_folds(table, P)
    scored = {r["user_id"]: r for r in validation.out_of_fold(table, fitted, "m").collect()}
    assert len(scored) == len(rows)
    expected = []
    for fold, model in fitted.items():
        x, y = arrays([r for r in rows if r["fold"] != fold])
        trees = plain(x, y, cuts, P, table.n_rows)
        expected.append(shares(trees, 3))
        assert list(model.importance().values()) == pytest.approx(expected[-1], abs=1e-9)
        for r in rows:
            if r["fold"] == fold:
                found = scored[r["user_id"]]
                assert found["score"] == pytest.approx(probability(trees, arrays([r])[0][0]), abs=1e-9)
                assert found["prediction"] == float(found["score"] > 0.5)
    means = dict(zip(CORE_FEATURES, np.mean(expected, axis=0)))
    shown = validation.feature_importance(fitted, spark).collect()
    assert [r["feature"] for r in shown] == sorted(means, key=lambda f: -means[f])
    assert {r["feature"]: r["importance"] for r in shown} == pytest.approx(means, abs=1e-9)


def test_curve_equals_the_plain_version(table):
    small = BoostedTrees(rounds=4, depth=3)
    models, subsets = validation.fit_curve(table, small, steps=3, whole=True)
    cuts = small.cut_points(table.df, CORE_FEATURES)
    rows, whole = subsets.collect(), table.df.withColumnRenamed("ai_label", "label").collect()
    expected = {}
    for fold in range(3):
        for step in range(1, 4):
            x, y = arrays([r for r in rows if r["held_out"] == fold and r["first_step"] <= step])
            expected[fold, step] = plain(x, y, cuts, small, table.n_rows)
    expected[-1, 3] = plain(*arrays(whole), cuts, small, table.n_rows)
    for key, trees in expected.items():
        assert list(models[key].importance().values()) == pytest.approx(shares(trees, 3), abs=1e-9), key
    final = models.pop((-1, 3))
    scored = final.transform(table.df).collect()
    assert all(r["score"] == pytest.approx(probability(expected[-1, 3], [r[f] for f in CORE_FEATURES]), abs=1e-9) for r in scored)
    found = validation.curve_scores(table, {k: m for k, m in models.items() if k[0] >= 0}, subsets)
    for (step, part, fold), group in found.toPandas().groupby(["step", "part", "fold"]):
        own = [r for r in rows if r["held_out"] == fold and r["first_step"] <= step] if part == "train" else [r for r in whole if r["fold"] == fold]
        wanted = [probability(expected[fold, step], [r[f] for f in CORE_FEATURES]) for r in own]
        assert sorted(group["score"]) == pytest.approx(sorted(wanted), abs=1e-9)
    curve = validation.learning_curve(table, small, 3).orderBy("step").collect()
    assert [r["n_train"] for r in curve] == [33, 66, 100] and all(0.6 < r["cv_auc"] <= r["train_auc"] for r in curve)


def test_partitions_and_order_do_not_matter(table):
    rows = table.df.select(F.col("ai_label").alias("label"), *CORE_FEATURES, F.lit(-1).alias("held_out"), F.lit(1).alias("first_step"))
    fits = [P.fit_many(d, CORE_FEATURES, [-1], 1, table.n_rows)[-1, 1] for d in (rows.coalesce(1), rows.repartition(7).orderBy(F.rand(3)))]
    assert fits[0] == fits[1]


def test_rows_are_dealt_to_all_cores(spark, table, monkeypatch):
    """A large table that comes in one partition; nothing stays with the executors, and neither partitions nor who adds the sums matter."""
    rows = table.df.select(F.col("ai_label").alias("label"), *CORE_FEATURES, F.lit(-1).alias("held_out"), F.lit(1).alias("first_step"))
    written, write = [], boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda df: written.append(df.rdd.getNumPartitions()) or write(df))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()

    def fit():
        return BoostedTrees(rounds=12, depth=3).fit_many(rows.coalesce(1), CORE_FEATURES, [-1], 1, 400_000)[-1, 1]

    spread = fit()
    assert written == [8, 8] and spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    monkeypatch.setattr(boosting, "_CELLS_COLLECTED", 0)
    assert fit() == spread
    monkeypatch.setattr(boosting, "_LEAST_ROWS", 1_000_000)
    assert fit() == spread and written[-1] == 1


def test_a_task_knows_few_models(spark, table, monkeypatch):
    """Rows of many models lie in the order of the models, in equal parts, so that few tasks send sums of the same nodes."""
    written, write = [], boosting.cut_lineage
    monkeypatch.setattr(boosting, "cut_lineage", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(boosting, "_LEAST_ROWS", 100)
    subsets = validation.learning_subsets(table.df, 4, k=3).withColumnRenamed("ai_label", "label")
    monkeypatch.setattr(boosting, "intermediate_tables", lambda spark: contextlib.nullcontext())
    BoostedTrees(rounds=1, depth=2).fit_many(subsets, CORE_FEATURES, [0, 1, 2], 4, table.n_rows)
    blocks = written[0].select("target", "model", F.length("label").alias("n")).collect()
    assert sum(b["n"] for b in blocks) == sum(len(range(r["first_step"], 5)) for r in subsets.collect())
    met = {(b["target"], b["model"]) for b in blocks}
    assert len({t for t, _ in met}) == 8 and len(met) <= 12 + 7
    parts = [sum(b["n"] for b in blocks if b["target"] == t) for t in range(8)]
    assert max(parts) < 1.5 * min(parts)


def test_curve_scores_are_dealt_to_all_cores(spark, table):
    models, subsets = validation.fit_curve(table, BoostedTrees(rounds=2, depth=2), steps=2)
    scored = validation.curve_scores(table, models, subsets.coalesce(1))
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert scored.count() == 150 * (2 + 3)


def test_native_score_is_the_walk(spark, table):
    model = validation.final_fit(table, P)
    points = [(float(a), float(b), c) for a in (-9, 0, 0.3) for b in (-1, 0.5, 9) for c in (0.1, 99.0, math.nan, None)]
    df = spark.createDataFrame(points, "sd_rating double, kurtosis_rating double, skewness_rating double")
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "UDF"))
    nodes = {(n[0], n[1]): n for n in model.nodes}
    for r in model.transform(df).collect():
        margin = 0.0
        for tree in range(P.rounds):
            node = nodes[tree, 0]
            while node[2] is not None:
                value = r[node[2]]
                node = nodes[tree, node[4] + (0 if value is not None and value < node[3] else 1)]
            margin += node[5]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_deep_trees_score_by_words_of_leaves(spark):
    """Trees with more leaves than a word has bits; of every row's words one bit is left a tree, that of the leaf that a walk ends in."""
    rng, nodes = np.random.default_rng(8), []
    for tree in range(3):
        todo, n = [(0, 0)], 1
        while todo:
            node, level = todo.pop(0)
            if level == 7 + tree or (level > 2 and rng.random() < 0.1):
                nodes.append((tree, node, None, None, None, float(rng.normal()), None, 1.0))
                continue
            nodes.append((tree, node, "ab"[rng.integers(2)], float(rng.integers(-9, 10)) / 2, n, 0.0, 1.0, 1.0))
            todo += [(n, level + 1), (n + 1, level + 1)]
            n += 2
    model = BoostedModel(("a", "b"), tuple(nodes))
    points = [(x, y) for x in (*np.arange(-5.0, 5.1, 0.25).tolist(), math.nan, None, math.inf, -math.inf) for y in (-9.0, -0.0, 0.5, 2.25, 9.0, None)]
    cuts, masks, values = boosting._leaf_masks(model)
    leaves = [sum(1 for n in nodes if n[0] == tree and n[2] is None) for tree in range(3)]
    assert max(leaves) > 64 and len(values) == sum(-(-n // 64) for n in leaves)
    found = {(n[0], n[1]): n for n in nodes}
    for r, (x, y) in zip(model.transform(spark.createDataFrame(points, "a double, b double").coalesce(1)).collect(), points, strict=True):
        margin, row = 0.0, {"a": x, "b": y}
        for tree in range(3):
            node = found[tree, 0]
            while node[2] is not None:
                value = row[node[2]]
                node = found[tree, node[4] + (0 if value is not None and value < node[3] else 1)]
            margin += node[5]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)
        bins = [len(c) if v is None or math.isnan(v) else int(np.searchsorted(c, v, "right")) for v, c in zip((x, y), cuts, strict=True)]
        assert sum(((a & b) % 2**64).bit_count() for a, b in zip(masks[0][bins[0]], masks[1][bins[1]], strict=True)) == 3


def test_ledger_and_round_trip(spark, table, tmp_path):
    model = validation.final_fit(table, P)
    model.save(spark, str(tmp_path / "m"))
    assert BoostedModel.load(spark, str(tmp_path / "m")) == model
    ledger = model.ledger(spark)
    top = ledger.filter("node = 0 and tree = 0").first()
    assert top["gain"] > 0 and top["cover"] == pytest.approx(0.25 * 150)
    assert ledger.filter("feature is not null").filter("gain <= 0 or value <> 0").count() == 0


def test_constant_features_and_one_class(spark):
    rows = spark.createDataFrame([(1.0, 2.0, -1, 1)] * 9, "label double, sd_rating double, held_out int, first_step int")
    model = BoostedTrees(rounds=3).fit_many(rows, ["sd_rating"], [-1], 1, 9)[-1, 1]
    assert all(n[2] is None for n in model.nodes) and model.importance() == {"sd_rating": 0.0}
    assert model.transform(rows).first()["score"] > 0.5


def test_registered_scores_equal_the_plain_version(spark, monkeypatch):
    """The query on its own table, with fewer rounds than it has there."""
    small = BoostedTrees(rounds=3)
    monkeypatch.setattr(catalog, "_builders", lambda: {"boosted_trees": small})
    found = {r["user_id"]: r["score"] for r in catalog.q_gbt_oof(spark, DATA).collect()}
    table = catalog._table(spark, DATA)
    rows = table.df.withColumnRenamed("ai_label", "label").collect()
    cuts = small.cut_points(table.df, CORE_FEATURES)
    for fold in sorted(table.fold_rows):
        trees = plain(*arrays([r for r in rows if r["fold"] != fold]), cuts, small, table.n_rows)
        for r in rows:
            if r["fold"] == fold:
                assert found.pop(r["user_id"]) == pytest.approx(probability(trees, arrays([r])[0][0]), abs=1e-9)
    assert not found
