"""Rating tables derived from the test tables (see ``TESTDATA.md``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeded import pick, seeded_key
from ..operators.sampling import TEMPERATURES

# Both rating formulas below can only give these.
LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0)
# Rows of a large table that one task sorts for a join.
_ROWS_SORTED = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _quantity_rating():
    return F.ceil(F.col("l_quantity") / 10.0).cast("double")


def ratings_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Few raters with many ratings."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("movie_id"), _quantity_rating().alias("rating")
    )


def ratings_by_customer(spark: SparkSession, folder: str, titles: bool = True) -> DataFrame:
    """Many raters with few ratings; the human side. Titles need one more join.

    Where the session's partitions would be too large to sort in memory, both tables are dealt to as many as their rows need. Counts the lines.
    """
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    wanted = -(-lines.count() // _ROWS_SORTED)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, orders = lines.repartition(wanted, "l_orderkey"), orders.repartition(wanted, "o_orderkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = [
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("movie_id"),
        _quantity_rating().alias("rating"),
    ]
    if titles:
        joined = joined.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        columns.insert(1, F.col("p_name").alias("movie"))
    return joined.select(*columns)


def ratings_by_event_user(spark: SparkSession, folder: str) -> DataFrame:
    """The machine side; ``movie_id`` is unique."""
    rating = F.least(F.lit(5.0), 1.0 + F.floor(F.col("value") / 25.0)).cast("double")
    return table(spark, folder, "events").select(
        "user_id", F.col("event_type").alias("movie"), F.col("event_id").alias("movie_id"), rating.alias("rating")
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Response lines around the event ratings: some cut off, some empty, some not numbers."""
    rated = ratings_by_event_user(spark, folder)
    text = F.when(F.col("movie") == "error", "n/a").otherwise(F.col("rating").cast("int").cast("string"))
    full = F.concat(
        F.lit('{"response":{"candidates":[{"content":{"parts":[{"text":" '), text, F.lit('\\n"}]}}]}')
    )
    opening = (
        F.when(F.col("movie_id") % 51 == 0, F.lit("{"))
        .when(F.col("movie_id") % 53 == 0, F.lit('{"response":{"candidates":[]},'))
        .otherwise(F.concat(full, F.lit(",")))
    )
    temperature = pick(TEMPERATURES, seeded_key(42, F.lit("temperature"), "user_id"))
    line = F.concat(
        opening,
        F.lit('"user_id":'),
        F.col("user_id").cast("string"),
        F.lit(',"movie":"'),
        F.col("movie"),
        F.lit('","movie_id":'),
        F.col("movie_id").cast("string"),
        F.lit(',"temperature":'),
        temperature.cast("string"),
        F.lit("}"),
    )
    cut = F.when(F.col("movie_id") % 50 == 0, F.substring(line, 1, 30)).otherwise(line)
    return rated.select("movie_id", cut.alias("value"))
