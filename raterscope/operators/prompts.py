"""Requests that ask a language model for ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import pick, seeded_key
from ..functions.text import clean_text
from ..session import cut_lineage
from .sampling import TEMPERATURES, sample_users

# The prompt and the answer budget.
PROMPT = (
    "As a Netflix user, please rate the following movie on a scale of 1 to 5.\n"
    "Movie: {movie}\n"
    "Provide only the numeric rating."
)
MAX_OUTPUT_TOKENS = 64

# A sample of this many users is a few megabytes of ids: small enough to broadcast.
_BROADCAST_USERS = 100_000


def prompt_text(movie: Column, template: str = PROMPT) -> Column:
    """Prompt with the title filled in."""
    before, after = template.split("{movie}")
    return F.concat(F.lit(before), movie, F.lit(after))


def sample_requests(
    ratings: DataFrame,
    n_users: int,
    temperatures: Sequence[float] = TEMPERATURES,
    seed: int = 42,
) -> DataFrame:
    """Ratings of ``n_users`` random users with the temperature drawn for each user.

    A large sample is written before the join, so that adaptive execution can split the ratings
    of a very active user.
    """
    users = sample_users(ratings, n_users, seed).withColumn(
        "temperature", pick(temperatures, seeded_key(seed, F.lit("temperature"), "user_id"))
    )
    small = n_users <= _BROADCAST_USERS
    return ratings.join(F.broadcast(users) if small else cut_lineage(users), "user_id")


def build_requests(
    ratings: DataFrame, template: str = PROMPT, max_output_tokens: int = MAX_OUTPUT_TOKENS
) -> DataFrame:
    """One request per rating: nested ``request`` plus the fields the service echoes."""
    movie = clean_text("movie")
    part = F.struct(prompt_text(movie, template).alias("text"))
    content = F.struct(F.lit("user").alias("role"), F.array(part).alias("parts"))
    settings = F.struct(
        F.lit(max_output_tokens).alias("max_output_tokens"), F.col("temperature").alias("temperature")
    )
    request = F.struct(F.array(content).alias("contents"), settings.alias("generationConfig"))
    return ratings.select(
        request.alias("request"), "user_id", movie.alias("movie"), "movie_id", "temperature"
    )


def request_lines(requests: DataFrame) -> DataFrame:
    """Requests as one JSON text per row; absent fields are written as null."""
    line = F.to_json(F.struct(*requests.columns), {"ignoreNullFields": "false"})
    return requests.select(line.alias("value"))
