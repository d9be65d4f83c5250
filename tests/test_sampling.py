from collections import Counter

import pytest
from pyspark.sql import functions as F

from raterscope.errors import NotEnoughUsersError
from raterscope.functions.seeded import seeded_key
from raterscope.operators import activity, ranking, sampling, splits


@pytest.fixture(scope="module")
def table(spark):
    """User 0 holds a third of the rows."""
    return spark.range(9000).selectExpr(
        "if(id % 3 = 0, 0, 1 + id % 20) AS user_id", "id AS movie_id", "double(1 + id % 5) AS rating"
    ).cache()


def per_user(df):
    return {r["user_id"]: r["count"] for r in df.groupBy("user_id").count().collect()}


def test_activity(table):
    counts = per_user(table)
    assert per_user(activity.qualified_ratings(table, 400)) == {u: n for u, n in counts.items() if n >= 400}
    assert activity.distinct_users(table).first()["n_users"] == len(counts)
    assert activity.distinct_users(table, relative_error=0.05).first()["n_users"] == pytest.approx(len(counts), rel=0.2)
    summary = activity.summarise_output(table).first()
    assert (summary["n_rows"], summary["n_users"]) == (9000, len(counts))
    assert [r["movie_id"] for r in activity.preview(table, ["movie_id"]).collect()] == [0, 1, 2, 3, 4]
    empty = activity.summarise_output(table.filter("false")).first()
    assert (empty["n_rows"], empty["n_users"]) == (0, 0)


@pytest.mark.parametrize("k, min_count", [(10, 0), (10, 200), (200, 200), (400, 301), (1500, 0), (5, 1200)])
def test_sample_per_user(table, k, min_count):
    counts = per_user(table)
    sample = sampling.sample_per_user(table, k, ["movie_id"], min_count=min_count)
    assert per_user(sample) == {u: min(n, k) for u, n in counts.items() if n >= min_count}
    assert sample.subtract(table).count() == 0
    assert sample.distinct().count() == sample.count()


def test_sample_is_the_smallest_keys_whatever_the_path(table):
    """The salted path above the rank limit and the direct path keep the same rows."""
    direct = sampling.sample_per_user(table, 900, ["movie_id"])
    salted = sampling.sample_per_user(table, 900, ["movie_id"], min_count=1200)
    hot = direct.filter("user_id = 0")
    assert salted.select("user_id").distinct().count() == 1
    assert {r["movie_id"] for r in hot.collect()} == {r["movie_id"] for r in salted.collect()}


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_samples_do_not_depend_on_partitions(table, partitions):
    other = table.repartition(partitions)
    for draw in (
        lambda d: sampling.sample_per_user(d, 7, ["movie_id"]),
        lambda d: sampling.sample_about(d, 500, ["movie_id"]),
        lambda d: sampling.sample_users(d, 5),
    ):
        assert Counter(map(tuple, draw(table).collect())) == Counter(map(tuple, draw(other).collect()))


def test_seed_changes_the_sample(table):
    one, two = ({r["movie_id"] for r in sampling.sample_about(table, 500, ["movie_id"], s).collect()} for s in (1, 2))
    assert one != two


def test_sample_about(table):
    assert sampling.sample_about(table, 3000, ["movie_id"]).count() == pytest.approx(3000, abs=250)
    assert sampling.sample_about(table, 90_000, ["movie_id"]).count() == 9000
    assert sampling.sample_about(table.filter("false"), 100, ["movie_id"]).count() == 0


def test_sample_users(table):
    assert sampling.sample_users(table, 5).distinct().count() == 5
    with pytest.raises(NotEnoughUsersError):
        sampling.require_users(table, 4000)
    assert sampling.require_users(table, 5) is table


def test_window_group_limit_runs_before_the_shuffle(table):
    plan = sampling.sample_per_user(table, 300, ["movie_id"], min_count=300)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_assign_choice(table):
    users = table.select("user_id").distinct()
    one = {r["user_id"]: r["temperature"] for r in sampling.assign_choice(users).collect()}
    two = {r["user_id"]: r["temperature"] for r in sampling.assign_choice(users.repartition(3)).collect()}
    assert one == two and set(one.values()) <= set(sampling.TEMPERATURES)


def test_hashed_rank_is_row_number(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 < 7, 0, 1) AS label")
    ranked = ranking.hashed_rank(df, ["label"], seeded_key(1, "id"))
    rows = ranked.withColumn("key", seeded_key(1, F.col("id"))).collect()
    for label in (0, 1):
        mine = sorted((r["key"], r["rank"]) for r in rows if r["label"] == label)
        assert [rank for _, rank in mine] == list(range(1, len(mine) + 1))
        assert {r["group_size"] for r in rows if r["label"] == label} == {len(mine)}


def test_totals_before(spark):
    df = spark.range(20_000).selectExpr("id % 2 AS g", "if(id % 5 = 0, id, id / 1e6) AS x", "id % 7 AS n").groupBy("g", "x").agg(
        F.sum("n").alias("n")
    )
    rows = ranking.totals_before(df, ["g"], "x", ["n"]).collect()
    for group in (0, 1):
        total = 0
        for row in sorted((r for r in rows if r["g"] == group), key=lambda r: r["x"]):
            assert row["n_before"] == total
            total += row["n"]
        assert {r["n_total"] for r in rows if r["g"] == group} == {total}
    assert len(rows) == df.count()


@pytest.fixture(scope="module")
def classes(spark):
    return spark.range(1000).selectExpr("id AS user_id", "int(if(id < 870, 0, 1)) AS ai_label", "double(id) AS x").cache()


def test_balance(spark, classes):
    assert {r["ai_label"]: r["count"] for r in splits.balance_classes(classes).groupBy("ai_label").count().collect()} == {0: 130, 1: 130}
    small = spark.createDataFrame([(i, int(i > 1)) for i in range(7)], "user_id long, ai_label int")
    assert sorted(r["ai_label"] for r in splits.balance_classes(small).collect()) == [0, 0, 1, 1]


def test_folds(classes):
    rows = splits.assign_folds(classes).collect()
    assert len(rows) == 1000 and len({r["user_id"] for r in rows}) == 1000
    for label in (0, 1):
        sizes = Counter(r["fold"] for r in rows if r["ai_label"] == label)
        assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_balanced_folds_equal_folds_of_the_balanced_table(classes):
    once = splits.balanced_folds(classes)
    twice = splits.assign_folds(splits.balance_classes(classes))
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, twice.collect()))


def test_learning_subsets(classes):
    folded = splits.balanced_folds(classes)
    rows = splits.learning_subsets(folded).collect()
    fold_sizes = Counter(r["fold"] for r in folded.collect())
    for fold in range(6):
        mine = [r for r in rows if r["held_out"] == fold]
        size = sum(fold_sizes.values()) - fold_sizes[fold]
        assert len(mine) == size and all(r["fold"] != fold and r["train_size"] == size for r in mine)
        for step in range(1, 11):
            assert sum(r["first_step"] <= step for r in mine) == step * size // 10


def test_rows_without_a_user_are_not_sampled(spark):
    rows = [(None, i, 1.0) for i in range(5)] + [(1, i, 1.0) for i in range(3)]
    table = spark.createDataFrame(rows, "user_id long, movie_id long, rating double")
    assert {r["user_id"] for r in sampling.sample_per_user(table, 10, ["movie_id"]).collect()} == {1}
