import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from raterscope.errors import MissingColumnsError
from raterscope.operators import statistics as S
from raterscope.schemas import CORE_FEATURES, STATISTICS

LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0)
PLANS = [None, LEVELS, "discover"]


def expected(values):
    x = np.sort(np.array(values, dtype=float))
    n, mean = len(x), x.mean()
    m2, m3, m4 = (((x - mean) ** k).mean() for k in (2, 3, 4))

    def quantile(p):
        return x[math.ceil(p * n) - 1]

    levels, counts = np.unique(x, return_counts=True)
    p = counts / n
    return {
        "mean_rating": mean,
        "median_rating": quantile(0.5),
        "mode_rating": levels[np.argmax(counts)],
        "sd_rating": x.std(ddof=1),
        "max_rating": x[-1],
        "min_rating": x[0],
        "iqr_rating": quantile(0.75) - quantile(0.25),
        "kurtosis_rating": m4 / m2**2 - 3,
        "skewness_rating": m3 / m2**1.5,
        "entropy_rating": -(p * np.log(p)).sum(),
    }


@pytest.mark.parametrize("levels", PLANS)
def test_known_rater(ratings, levels):
    row = S.user_statistics(ratings({3: [1, 2, 2, 5, 5]}), levels=levels).first()
    assert row["mode_rating"] == 2 and row["median_rating"] == 2 and row["iqr_rating"] == 3
    assert row["sd_rating"] == pytest.approx(1.870829, abs=1e-6)
    assert row["kurtosis_rating"] == pytest.approx(-1.724490, abs=1e-6)
    assert row["skewness_rating"] == pytest.approx(0.256120, abs=1e-6)


@pytest.mark.parametrize("levels", PLANS)
def test_undefined_raters_are_dropped_or_kept(ratings, levels):
    table = ratings({1: [5, 5, 5], 2: [3], 4: [1, 2]})
    assert [r["user_id"] for r in S.user_statistics(table, levels=levels).collect()] == [4]
    kept = {r["user_id"]: r for r in S.user_statistics(table, levels=levels, drop_undefined=False).collect()}
    assert kept[1]["sd_rating"] == 0 and kept[1]["kurtosis_rating"] is None
    assert kept[1]["skewness_rating"] is None and str(kept[1]["entropy_rating"]) == "0.0"
    assert kept[2]["sd_rating"] is None and kept[2]["mean_rating"] == 3


@pytest.mark.parametrize("levels", PLANS)
def test_only_chosen_statistics_decide(ratings, levels):
    table = ratings({1: [5, 5, 5], 2: [3]})
    only_sd = S.user_statistics(table, levels=levels, features=["sd_rating"])
    assert [r["user_id"] for r in only_sd.collect()] == [1]
    assert only_sd.columns == ["user_id", "sd_rating"]
    assert S.user_statistics(table, levels=levels, features=["mode_rating"]).count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.integers(1, 5), st.lists(st.integers(1, 5), min_size=2, max_size=40), min_size=1, max_size=4
    )
)
def test_both_plans_equal_numpy(ratings, by_user):
    usable = {u: v for u, v in by_user.items() if len(set(v)) > 1}
    for levels in (None, LEVELS):
        rows = {r["user_id"]: r for r in S.user_statistics(ratings(by_user), levels=levels).collect()}
        assert set(rows) == set(usable)
        for user, values in usable.items():
            for name, value in expected(values).items():
                assert rows[user][name] == pytest.approx(value, abs=1e-9), (levels, user, name)


def test_half_steps_and_single_level(ratings):
    table = ratings({1: [0.5, 1.5, 1.5, 4.5]})
    row = S.user_statistics(table, levels=[0.5, 1.5, 4.5]).first()
    for name, value in expected([0.5, 1.5, 1.5, 4.5]).items():
        assert row[name] == pytest.approx(value)
    assert S.user_statistics(ratings({1: [2, 2]}), levels=[2], drop_undefined=False).first()["mode_rating"] == 2


def test_rating_off_the_scale_stops_the_job(ratings):
    with pytest.raises(Exception, match="outside the declared levels"):
        S.user_statistics(ratings({1: [1, 2, 3.5]}), levels=LEVELS).collect()


def test_nulls(spark):
    rows = [(1, None, 1, 4.0), (1, "a", 2, None), (1, "b", 3, float("nan")), (1, "c", 4, 2.0), (1, "d", 5, 3.0), (None, "e", 6, 5.0)]
    table = spark.createDataFrame(rows, "user_id long, movie string, movie_id long, rating double")
    for levels in (None, LEVELS):
        every = S.user_statistics(table, levels=levels).first()
        assert (every["mean_rating"], every["max_rating"]) == (2.5, 3.0)
        narrow = S.user_statistics(table, levels=levels, subset=["user_id", "rating"]).first()
        assert (narrow["mean_rating"], narrow["max_rating"]) == (3.0, 4.0)


def test_scoring_features_agree_with_training_features(spark, ratings):
    table = ratings({1: [1, 2, 5, 5], 2: [4, 4], 3: [2], 4: [None, 3, 1]})
    trained = {r["user_id"]: r for r in S.user_statistics(table, features=CORE_FEATURES).collect()}
    scored = {r["user_id"]: r for r in S.core_features(table).collect()}
    assert set(scored) == {1, 2, 3, 4} and set(trained) == {1, 4}
    for user, row in trained.items():
        for name in CORE_FEATURES:
            assert scored[user][name] == pytest.approx(row[name])
    combined = S.combined_features(table).first()
    everything = S.user_statistics(
        ratings({9: [1, 2, 5, 5, 4, 4, 2, 3, 1]}), features=CORE_FEATURES
    ).first()
    assert combined["user_id"] == "Combined"
    for name in CORE_FEATURES:
        assert combined[name] == pytest.approx(everything[name])


def test_rater_without_ratings_is_kept_for_scoring(ratings):
    row = S.core_features(ratings({1: [None, None]})).first()
    assert row["user_id"] == 1 and row["sd_rating"] is None


def test_discover_levels(ratings):
    assert S.discover_levels(ratings({1: [3, 1, None], 2: [2]})) == [1, 2, 3]
    assert S.discover_levels(ratings({1: [i / 7 for i in range(65)]})) is None
    assert S.discover_levels(ratings({1: [i / 7 for i in range(64)]})) is not None


def test_histogram_mode_and_entropy(ratings):
    table = ratings({1: [1, 1, 2, 2, 3], 2: [4]})
    shares = {(r["user_id"], r["rating"]): (r["rating_count"], r["share"]) for r in S.rating_histogram(table).collect()}
    assert shares == {(1, 1.0): (2, 0.4), (1, 2.0): (2, 0.4), (1, 3.0): (1, 0.2), (2, 4.0): (1, 1.0)}
    assert sorted((r["user_id"], r["rating"]) for r in S.tied_modes(table).collect()) == [(1, 1.0), (1, 2.0), (2, 4.0)]
    assert {r["user_id"]: r["mode_rating"] for r in S.user_mode(table).collect()} == {1: 1.0, 2: 4.0}
    entropy = {r["user_id"]: r["entropy_rating"] for r in S.user_entropy(table).collect()}
    assert entropy[2] == 0 and entropy[1] == pytest.approx(expected([1, 1, 2, 2, 3])["entropy_rating"])


def test_hot_rater_with_continuous_ratings(spark):
    """A rater with a third of all rows, each value different."""
    table = spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 0, id % 50) AS user_id", "sin(id) AS rating"
    )
    row = S.user_statistics(table).filter("user_id = 0").first()
    values = np.sin(np.concatenate([np.arange(0, 60_000, 3), [i for i in range(60_000) if i % 50 == 0 and i % 3]]))
    want = expected(values)
    for name in STATISTICS:
        tolerance = 1e-3 if name in ("median_rating", "iqr_rating") else 1e-9
        assert row[name] == pytest.approx(want[name], abs=tolerance), name


def test_missing_column_and_unknown_statistic(ratings):
    with pytest.raises(MissingColumnsError):
        S.user_statistics(ratings({1: [1]}), rating_col="stars")
    with pytest.raises(ValueError):
        S.user_statistics(ratings({1: [1]}), features=["variance"])


def test_one_shuffle_in_the_levels_plan(spark, folder):
    from raterscope.sources import views

    df = S.user_statistics(views.ratings_by_supplier(spark, folder), levels=LEVELS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    assert "SortAggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5, 1e10])
def test_both_plans_agree_on_any_scale(ratings, scale):
    """Far levels, negative ones and half steps: sums about the middle of the scale would cancel."""
    rng = np.random.default_rng(int(scale) % 97)
    levels = [round(x, 1) * scale for x in (-2.5, -1.0, 0.0, 0.5, 1.0, 1.5, 2.0)] + [1_000_001.0 * scale]
    by_user = {u: [levels[i] for i in rng.integers(0, 7 + (u % 3 == 0), size=rng.integers(2, 40))] for u in range(1, 40)}
    by_user[99] = [levels[-1], levels[-1], levels[0]]
    table = ratings(by_user)
    one = {r["user_id"]: r for r in S.user_statistics(table, levels=levels).collect()}
    other = {r["user_id"]: r for r in S.user_statistics(table).collect()}
    assert one.keys() == other.keys()
    for user, row in one.items():
        for name in S.STATISTICS:
            assert row[name] == pytest.approx(other[user][name], rel=1e-9, abs=1e-9 * scale), (user, name)


def test_near_levels_far_from_zero(ratings):
    table = ratings({1: [1e8 + 1, 1e8 + 2, 1e8 + 2, 1e8 + 5, 1e8 + 5]})
    row = S.user_statistics(table, levels=[1e8 + n for n in range(1, 6)]).first()
    assert row["sd_rating"] == pytest.approx(1.870829, abs=1e-6)
    assert row["kurtosis_rating"] == pytest.approx(-1.724490, abs=1e-6)


def test_levels_must_be_finite(ratings):
    with pytest.raises(ValueError, match="finite"):
        S.user_statistics(ratings({1: [1, 2]}), levels=[1, float("inf")])
    assert S.discover_levels(ratings({1: [1, 2, float("inf")]})) is None


def test_rows_without_a_rating_are_ignored_in_both_plans(ratings):
    table = ratings({1: [1, 2, None, 5]})
    rows = [S.user_statistics(table, levels=levels, subset=["user_id"]).first() for levels in (None, [1, 2, 5])]
    assert rows[0]["mean_rating"] == pytest.approx(rows[1]["mean_rating"]) and rows[0]["max_rating"] == rows[1]["max_rating"] == 5


def test_histogram_reads_and_shuffles_the_ratings_once(ratings):
    plan = S.rating_histogram(ratings({1: [1, 1, 2]}))._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "LogicalRDD" not in plan  # only the written counts are read


def test_counts_of_deliveries_add_up(spark, ratings, tmp_path, monkeypatch):
    import random

    from raterscope.operators import statistics
    from raterscope.plans import jobs
    from raterscope.sources import readers, writers

    draw = random.Random(1)
    by_user = {u: [draw.randint(1, 5) for _ in range(draw.randint(1, 30))] for u in range(40)}
    halves = [{u: r[: len(r) // 2] for u, r in by_user.items()}, {u: r[len(r) // 2 :] for u, r in by_user.items()}]
    state = str(tmp_path / "state")
    for i, half in enumerate(halves):
        writers.write_csv(ratings(half), str(tmp_path / f"r{i}"))
    jobs.add_delivery(spark, str(tmp_path / "r0"), state, "a")
    # A run that ends between its write and its commit leaves nothing, and is repeated.
    with monkeypatch.context() as broken:
        broken.setattr(writers, "write_parquet", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.add_delivery(spark, str(tmp_path / "r1"), state, "b")
    ratings(halves[1]).write.parquet(f"{state}/_adding-left-behind")
    for _ in range(2):
        added = jobs.add_delivery(spark, str(tmp_path / "r1"), state, "b").first()
        assert added["n_rows"] == sum(map(len, halves[1].values()))
    jobs.delivered_statistics(spark, state, str(tmp_path / "out"))
    whole = statistics.user_statistics(ratings(by_user), levels=[1, 2, 3, 4, 5])
    found = {r["user_id"]: tuple(r)[1:] for r in readers.read_stats_csv(spark, str(tmp_path / "out")).collect()}
    wanted = {r["user_id"]: tuple(r)[1:] for r in whole.collect()}
    assert found.keys() == wanted.keys()
    assert all(found[u] == pytest.approx(wanted[u], abs=1e-9) for u in wanted)
    with pytest.raises(ValueError, match="another scale"):
        jobs.delivered_statistics(spark, state, str(tmp_path / "no"), levels=[1, 2, 3])
