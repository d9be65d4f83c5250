"""One rater with a third of all rows: the joins on raters must be split by adaptive execution."""

import pytest

from raterscope.operators import activity, prompts, statistics
from raterscope.sources import views

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def skewed(tight):
    return tight.range(0, 120_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 7, 1000 + id % 500) AS user_id",
        "concat('movie ', id) AS movie",
        "id AS movie_id",
        "id / 7 AS rating",
    )


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_qualified_ratings_split(skewed):
    rows, plan = final_plan(activity.qualified_ratings(skewed, 100))
    assert len(rows) == 120_000
    assert "skew=true" in plan


def test_histogram_and_ties_split(skewed):
    rows, plan = final_plan(statistics.rating_histogram(skewed))
    assert len(rows) == 120_000 and "skew=true" in plan
    rows, plan = final_plan(statistics.tied_modes(skewed))
    assert len(rows) == 120_000 and "skew=true" in plan


def test_large_request_sample_split(skewed, monkeypatch):
    monkeypatch.setattr(prompts, "_BROADCAST_USERS", 0)
    rows, plan = final_plan(prompts.sample_requests(skewed, 501))
    assert len(rows) == 120_000 and "skew=true" in plan


def test_quantile_sketches_of_a_hot_rater_are_spread(spark):
    """A third of all rows are one rater's: no task sketches or merges more than its share, and ranks stay right."""
    rated = spark.range(0, 240_000, 1, 64).selectExpr("if(id % 3 = 0, 7, 1000 + id % 500) AS user_id", "pmod(hash(id), 1000003) / 7D AS _rating")
    sketches = statistics.quantile_sketches(rated, "user_id")
    rows = sketches.selectExpr("user_id", "kll_sketch_get_n_double(_sketch) AS n").filter("user_id = 7").collect()
    assert len(rows) == statistics.SKETCH_SALTS and sum(r["n"] for r in rows) == 80_000
    assert max(r["n"] for r in rows) <= 1.1 * 80_000 / statistics.SKETCH_SALTS
    hot = sorted(r["_rating"] for r in rated.filter("user_id = 7").collect())
    for share, value in zip(statistics.QUARTILES, statistics.merged_quantiles(sketches, "user_id").filter("user_id = 7").first()["_quartiles"]):
        assert value in hot and abs(hot.index(value) / len(hot) - share) < 0.005


def test_sketches_of_deliveries_give_the_quantiles_of_all(spark):
    """Exact, observed values for up to ``SKETCH_SIZE`` ratings, however these are cut into deliveries and partitions."""
    rated = spark.range(0, 3_000, 1, 8).selectExpr("id % 5 AS user_id", "pmod(hash(id), 97) / 3D AS _rating")
    halves = [statistics.quantile_sketches(rated.filter(f"_rating {test} 10"), "user_id") for test in ("<", ">=")]
    got = {r["user_id"]: r["_quartiles"] for r in statistics.merged_quantiles(halves[0].unionByName(halves[1]), "user_id").collect()}
    own = {}
    for r in rated.collect():
        own.setdefault(r["user_id"], []).append(r["_rating"])
    assert got == {u: [sorted(v)[-int(-len(v) * q // 1) - 1] for q in statistics.QUARTILES] for u, v in own.items()}
    assert statistics.merged_quantiles(halves[0].limit(0), "user_id").count() == 0


def test_large_tables_are_joined_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """More lines than the session's partitions can sort in memory; a small table is left to the session. Rows are the same."""
    lines = [(i % 60 if i % 7 else None, 1, float(i % 50 + 1)) for i in range(200)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k % 11) for k in [*range(50), 3]] + [(None, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")

    def found():
        joined = views.ratings_by_customer(spark, str(tmp_path), titles=False)
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        return sorted(map(tuple, joined.collect())), plan.count("RepartitionByExpression")

    plain = found()
    monkeypatch.setattr(views, "_ROWS_SORTED", 10)
    parts = found()
    assert plain[1] == 0 and parts[1] == 2
    expected = sorted((c, 1, float(-(-q // 10))) for k, _, q in lines if k is not None for o, c in orders if o == k)
    assert parts[0] == plain[0] == expected
