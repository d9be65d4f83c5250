import os
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterscope import session
from raterscope.__main__ import main
from raterscope.errors import MissingColumnsError, NoDataError
from raterscope.operators import classifiers, evaluation, knn, scoring, splits, validation
from raterscope.plans import jobs
from raterscope.schemas import CORE_FEATURES
from raterscope.session import shared_folder
from raterscope.sources import models


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i, i % 2, *map(float, rng.normal((i % 2) * 2.0, 1.0, 3))) for i in range(240)
    ]
    return spark.createDataFrame(rows, "user_id long, ai_label int, sd_rating double, kurtosis_rating double, skewness_rating double").cache()


@pytest.fixture(scope="module")
def table(labelled):
    return validation.prepare_folds(splits.balanced_folds(labelled, k=3))


SMALL = classifiers.builders(rounds=3, trees=5, svm_iterations=5)


@pytest.mark.parametrize("name", SMALL)
def test_every_row_is_scored_once_out_of_fold(table, name):
    scored = validation.cross_validate(table, SMALL[name], name).cache()
    assert scored.count() == scored.select("user_id").distinct().count() == 240
    assert evaluation.pooled_auc(scored).first()["pooled_auc"] > 0.9
    wrong = scored.join(table.df, "user_id").filter(F.col("label") != F.col("ai_label")).count()
    assert wrong == 0


def test_importance(spark, table):
    fitted = validation.fit_folds(table, SMALL["random_forest"])
    rows = validation.feature_importance(fitted, spark).collect()
    assert {r["feature"] for r in rows} == set(CORE_FEATURES)
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_comparison(table):
    scored = validation.compare_models(table, {"logistic_regression": SMALL["logistic_regression"]})
    rows = validation.mean_auc_by_model(scored).collect()
    assert {r["model"] for r in rows} == {"logistic_regression", "nearest_neighbours"}
    assert all(r["mean_fold_auc"] > 0.9 for r in rows)


def test_learning_curve(table):
    rows = validation.learning_curve(table, SMALL["logistic_regression"], steps=2).orderBy("step").collect()
    assert [(r["step"], r["n_train"]) for r in rows] == [(1, 80), (2, 160)]
    assert all(r["train_auc"] > 0.9 and r["cv_auc"] > 0.9 for r in rows)


def brute_neighbours(train, query, k):
    def distance(q, t):
        # sum() would compensate rounding and part ties that plain addition leaves equal
        gaps = [(a - b) * (a - b) for a, b in zip(q[1:], t[2:])]
        return gaps[0] + gaps[1] + gaps[2]

    found = {}
    for q in query:
        near = sorted((distance(q, t), t[0]) for t in train)
        found[q[0]] = [i for _, i in near[:k]]
    return found


@pytest.mark.parametrize("leaf_rows", [2000, 40])
@pytest.mark.parametrize("shape", ["spread", "copies"])
def test_neighbours_equal_brute_force(spark, leaf_rows, shape):
    """With small leaves most queries need other leaves; a third of the copies table is one point."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(400, 3))
    if shape == "copies":
        points[::3] = 0.0
        points = points.round(1)
    train = [(i, i % 2, *map(float, p)) for i, p in enumerate(points)]
    query = [(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(90, 3)).round(1))] + [(999, 0.0, 0.0, 0.0)]
    columns = "sd_rating double, kurtosis_rating double, skewness_rating double"
    train_df = spark.createDataFrame(train, f"user_id long, ai_label int, {columns}")
    query_df = spark.createDataFrame(query, f"user_id long, {columns}")
    rows = knn.nearest_neighbours(train_df, query_df, k=5, leaf_rows=leaf_rows).collect()
    got = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(row["user_id"], []).append(row["neighbour"])
    assert got == brute_neighbours(train, query, 5)


def test_neighbours_with_hot_leaf_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(2)
    columns = "sd_rating double, kurtosis_rating double, skewness_rating double"
    train = [(i, 0, *map(float, p)) for i, p in enumerate(rng.normal(size=(300, 3)))]
    query = [(i, 0.01, 0.02, float(i) / 1000) for i in range(200)]
    got = knn.nearest_neighbours(
        spark.createDataFrame(train, f"user_id long, ai_label int, {columns}"),
        spark.createDataFrame(query, f"user_id long, {columns}"),
        k=2,
        leaf_rows=50,
    ).collect()
    want = brute_neighbours(train, query, 2)
    assert {(r["user_id"], r["neighbour"]) for r in got} == {(q, n) for q, near in want.items() for n in near}


def test_fewer_points_than_k(spark):
    columns = "user_id long, ai_label int, sd_rating double, kurtosis_rating double, skewness_rating double"
    train = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 0, 1.0, 1.0, None)], columns)
    query = spark.createDataFrame([(5, 0, 1.0, 1.0, 1.0)], columns)
    assert [(r["score"], r["prediction"]) for r in knn.knn_classify(train, query).collect()] == [(1.0, 1.0)]


@pytest.fixture(scope="module")
def model(table):
    return validation.final_fit(table, SMALL["boosted_trees"])


def test_score_raters(spark, ratings, model):
    upload = ratings({1: [1, 2, 5, 5], 2: [4, 4], 3: [2], 4: [None]}).select("user_id", "rating")
    predictions, stats = scoring.score_raters(model, upload)
    assert predictions.columns == ["user_id", "Prediction", "Probability AI", "status"]
    assert stats.columns == ["user_id", "SD", "Skewness", "Kurtosis"]
    rows = {r["user_id"]: r for r in predictions.collect()}
    assert rows[1]["status"] == "ok" and rows[1]["Prediction"] in ("Human", "AI")
    assert 0 <= rows[1]["Probability AI"] <= 1
    for user in (2, 3, 4):
        assert rows[user]["status"] == "undefined_features" and rows[user]["Prediction"] is None
    assert {r["user_id"] for r in stats.collect()} == {1, 2, 3, 4}


def test_score_one_and_combined(spark, ratings, model):
    upload = ratings({1: [1, 2, 5, 5], 2: [4, 4, 3]}).select("user_id", "rating")
    one, _ = scoring.score_raters(model, upload, target_user="2")
    assert [r["user_id"] for r in one.collect()] == [2]
    with pytest.raises(NoDataError):
        scoring.score_raters(model, upload, target_user=77)
    combined, stats = scoring.score_combined(model, upload)
    assert [(r["user_id"], r["status"]) for r in combined.collect()] == [("Combined", "ok")]
    assert stats.count() == 1
    nothing, _ = scoring.score_combined(model, ratings({1: [None]}).select("user_id", "rating"))
    assert nothing.first()["status"] == "no_valid_ratings"
    with pytest.raises(MissingColumnsError):
        scoring.score_raters(model, upload, "user_id", "stars")
    with pytest.raises(MissingColumnsError):
        scoring.score_raters(model, upload.select("user_id"))


def test_column_names_with_dots_and_spaces(spark, model):
    upload = spark.createDataFrame([("u 1", "1"), ("u 1", "4"), ("u 1", "x"), ("u 1", "5")], "a string, b string").toDF("User Name", "my.rating")
    predictions, stats = scoring.score_raters(model, upload, target_user="u 1")
    assert predictions.columns[0] == "User Name" and stats.columns[0] == "User Name"
    assert predictions.first()["status"] == "ok"
    assert stats.first()["SD"] == pytest.approx(np.std([1, 4, 5], ddof=1))


def test_model_round_trip(spark, ratings, model, tmp_path):
    path = models.save_model(model, str(tmp_path))
    upload = ratings({1: [1, 2, 5, 5]}).select("user_id", "rating")
    before = scoring.score_raters(model, upload)[0].first()
    assert scoring.score_raters(models.load_model(path), upload)[0].first() == before


def test_no_answers_is_no_error(spark, tmp_path):
    (tmp_path / "none").mkdir()
    counts = jobs.answer_file(spark, str(tmp_path / "none"), str(tmp_path / "o"), str(tmp_path / "a"))
    assert counts.count() == 0 and not (tmp_path / "o").exists()


def test_core_features_only_and_command_line(spark, tmp_path, capsys):
    at = {n: str(tmp_path / n) for n in ("raw", "human", "machine", "dataset")}
    rated = spark.range(500).selectExpr(
        "id % 10 AS user_id", "'m' AS movie", "id AS movie_id", "double(1 + pmod(xxhash64(id), 5)) AS rating"
    )
    rated.write.option("header", True).csv(at["raw"])
    for side in ("human", "machine"):
        main(["statistics_table", at["raw"], at[side], "--features", *CORE_FEATURES])
    main(["labelled_table", at["human"], at["machine"], at["dataset"], "--features", *CORE_FEATURES])
    assert "ai_label" in capsys.readouterr().out
    made = spark.read.parquet(at["dataset"])
    assert made.columns == ["user_id", *CORE_FEATURES, "ai_label"] and made.count() == 20


def test_all_stages_from_file_to_file(spark, tmp_path):
    """Ratings -> sample -> requests -> answers -> statistics -> dataset -> model -> scores."""
    at = {n: str(tmp_path / n) for n in (
        "raw sample requests answers machine audit human_stats machine_stats dataset report models scores combined"
    ).split()}
    rated = spark.range(4000).selectExpr(
        "id % 40 AS user_id", "concat('Movie ', id) AS movie", "id AS movie_id",
        "double(1 + pmod(xxhash64(id), 5)) AS rating",
    )
    rated.write.option("header", True).csv(at["raw"])
    summary = jobs.qualify(spark, at["raw"], at["sample"], k=60, min_count=60).first()
    assert (summary["n_rows"], summary["n_users"]) == (2400, 40)
    assert jobs.request_file(spark, at["sample"], at["requests"], n_users=30).count() == 1800
    echoed = spark.read.option("recursiveFileLookup", True).text(at["requests"]).selectExpr(
        "concat('{\"response\":{\"candidates\":[{\"content\":{\"parts\":[{\"text\":\"',"
        " if(crc32(value) % 9 = 0, '5', if(crc32(value) % 9 = 1, 'none', '4')), '\"}]}}]},', substr(value, 2)) AS value"
    )
    echoed.write.text(at["answers"])
    counts = {r["status"]: r["n"] for r in jobs.answer_file(spark, at["answers"], at["machine"], at["audit"]).collect()}
    assert sum(counts.values()) == 1800 and set(counts) == {"ok", "non_numeric"}
    assert jobs.statistics_table(spark, at["sample"], at["human_stats"]).first()["n_users"] == 40
    made = jobs.statistics_table(spark, at["machine"], at["machine_stats"], synthetic=True).first()
    assert made["n_users"] == 30
    classes = jobs.labelled_table(spark, at["human_stats"], at["machine_stats"], at["dataset"])
    assert {r["ai_label"]: r["n"] for r in classes.collect()} == {0: 40, 1: 30}
    before = set(os.listdir(shared_folder(spark)))
    path = jobs.train(
        spark, at["dataset"], at["report"], at["models"], rounds=2, trees=3, svm_iterations=3, folds=3, curve_steps=2
    )
    assert set(os.listdir(shared_folder(spark))) == before
    curve = spark.read.parquet(f"{at['report']}/learning_curve").collect()
    assert {r["step"] for r in curve} == {1, 2}
    assert spark.read.parquet(f"{at['report']}/splits").count() > 0
    aucs = spark.read.parquet(f"{at['report']}/auc_mean").collect()
    assert len(aucs) == 5 and all(r["mean_fold_auc"] > 0.9 for r in aucs)
    scores = jobs.score(spark, path, at["sample"], at["scores"], "user_id", "rating")
    assert scores.count() == 40 and scores.filter("Prediction = 'Human'").count() > 35
    together = jobs.score(spark, path, at["machine"], at["combined"], "user_id", "rating", combine_all=True)
    assert together.first()["Prediction"] == "AI"
    assert spark.read.parquet(f"{at['combined']}/distribution").count() > 0


def test_ties_leave_no_leaf_empty_or_overfull(spark):
    """Sixty percent of the points share the largest value of the widest feature."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 3))
    points[:, 0] = np.where(rng.random(4000) < 0.6, 50.0, rng.uniform(0, 49, 4000))
    tree = knn._build_tree(points[::4], 5)
    sizes = np.bincount(tree.leaf(points))
    assert len(sizes) == 32 and sizes.min() > 0 and sizes.max() < 4000 / 8
    columns = "sd_rating double, kurtosis_rating double, skewness_rating double"
    train = [(i, i % 2, *map(float, p)) for i, p in enumerate(points[:600])]
    query = [(i, *map(float, p)) for i, p in enumerate(points[600:650])] + [(99, 49.9, 0.0, 0.0)]
    rows = knn.nearest_neighbours(
        spark.createDataFrame(train, f"user_id long, ai_label int, {columns}"),
        spark.createDataFrame(query, f"user_id long, {columns}"), k=5, leaf_rows=30,
    ).collect()
    got = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(row["user_id"], []).append(row["neighbour"])
    assert got == brute_neighbours(train, query, 5)


def test_first_user_of_text_ids(spark):
    from raterscope.operators.distributions import first_user_histogram

    def first(*ids):
        rows = [(i, float(n)) for n, i in enumerate(ids, 1)]
        return first_user_histogram(spark.createDataFrame(rows, "user_id string, rating double")).first()["bin"]

    assert first("10", "2", "30") == 2
    assert first("10", "2", "x") == 1


def test_threads_keep_their_tables(spark):
    """A table is removed at the end of the scope of its own thread, or of the one that started the thread, and of no other."""
    opened, written, closed = (threading.Event() for _ in range(3))

    def task(opens):
        if opens:
            with session.intermediate_tables(spark):
                opened.set()
                assert written.wait(60)
            closed.set()
            return None
        assert opened.wait(60)
        kept = session.cut_lineage(spark.range(3))
        written.set()
        assert closed.wait(60)
        assert kept.count() == 3
        return kept

    with session.intermediate_tables(spark):
        kept = validation._in_threads(task, [True, False], 2, spark)[1]
        path = Path(kept.inputFiles()[0].removeprefix("file://"))
        assert path.exists()
    assert not path.exists()


def test_compared_models_are_fitted_at_the_same_time(spark, monkeypatch):
    met = threading.Barrier(3, timeout=30)

    def scored(name):
        met.wait()
        return spark.createDataFrame([(name, 0, 1.0)], "model string, fold int, score double")

    monkeypatch.setattr(validation, "cross_validate", lambda table, build, name, parallelism: scored(name))
    monkeypatch.setattr(validation, "cross_validate_knn", lambda table, k, parallelism: scored("k"))
    table = validation.FoldedTable(spark.range(1), {0: 1})
    found = validation.compare_models(table, {"a": None, "b": None}, parallelism=3).collect()
    assert [r["model"] for r in found] == ["a", "b", "k"]
