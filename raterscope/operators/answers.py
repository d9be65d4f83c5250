"""Ratings read from the answers of a language model, with an audit status for every line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import default_text, strict_double

OK = "ok"
MALFORMED = "malformed"
NO_RESPONSE = "no_response"
NON_NUMERIC = "non_numeric"
OUT_OF_RANGE = "out_of_range"
BAD_ID = "bad_id"

_FIRST_PART = "response.candidates[0].content.parts[0]"


def _with_json(lines: DataFrame, column: str) -> DataFrame:
    """Add ``_json``: the line as a variant, or null unless the whole line is one JSON object.

    A parser that stops after the first value would accept trailing text. Inside an array with
    a sentinel behind it, the line must end where its object ends. Parsing has a column of its
    own, so that it happens once.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit(",0]")))
    alone = F.try_variant_get("_wrapped", "$[1]", "int").eqNullSafe(0)
    starts = F.ltrim(F.col(column), F.lit(" \t\r\n")).startswith("{")
    return (
        lines.withColumn("_wrapped", wrapped)
        .withColumn("_json", F.when(starts & alone, F.col("_wrapped")))
        .drop("_wrapped")
    )


def with_validity(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``is_valid``: whether the text is exactly one JSON object."""
    return _with_json(lines, column).withColumn("is_valid", F.col("_json").isNotNull()).drop("_json")


def split_valid_json(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid lines, and the rejected ones to be written to a quarantine output."""
    checked = with_validity(lines, column)
    return (
        checked.filter("is_valid").drop("is_valid"),
        checked.filter(~F.col("is_valid")).drop("is_valid"),
    )


def audit_answers(
    lines: DataFrame,
    column: str = "value",
    min_rating: float | None = None,
    max_rating: float | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Echoed fields, rating and ``status`` of every line; no line is lost. ``carry`` names columns to keep beside them.

    The first part of the first candidate must hold the rating as text. ``no_response`` covers
    an absent or empty answer at any level, ``malformed`` text that is no JSON object or whose
    answer is not text, ``non_numeric`` an answer that is not a plain number. With bounds given,
    ratings outside them are ``out_of_range``. A readable rating whose user or title id is no whole number
    is ``bad_id``. Only the ``ok`` rows carry a rating; all others carry the raw line, and the file
    it came from where ``lines`` has ``file_path``, so that the table doubles as their quarantine.
    """
    origin = [*[c for c in ("file_path",) if c in lines.columns], *carry]
    parsed = _with_json(lines.select(column, *origin), column)

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("_json", f"$[0].{path}", kind)

    read = parsed.select(
        F.col(column).alias("_line"),
        *origin,
        F.col("_json").isNotNull().alias("_valid"),
        (_lost(field("user_id")) | _lost(field("movie_id"))).alias("_bad_id"),
        default_text(field("movie")).alias("movie"),
        field("user_id").try_cast("bigint").alias("user_id"),
        field("movie_id").try_cast("bigint").alias("movie_id"),
        field("temperature").try_cast("double").alias("temperature"),
        field(_FIRST_PART, "variant").isNotNull().alias("_answered"),
        F.schema_of_variant(field(f"{_FIRST_PART}.text", "variant")).alias("_kind"),
        field(f"{_FIRST_PART}.text").alias("_text"),
    )
    number = read.withColumn("_number", strict_double("_text"))
    status = (
        F.when(~F.col("_valid"), MALFORMED)
        .when(~F.col("_answered"), NO_RESPONSE)
        .when(F.col("_kind") != "STRING", MALFORMED)
        .when(F.col("_number").isNull(), NON_NUMERIC)
    )
    if min_rating is not None:
        status = status.when(F.col("_number") < min_rating, OUT_OF_RANGE)
    if max_rating is not None:
        status = status.when(F.col("_number") > max_rating, OUT_OF_RANGE)
    status = status.when(F.col("_bad_id"), BAD_ID)
    return number.withColumn("status", status.otherwise(OK)).select(
        "movie",
        "user_id",
        "movie_id",
        "temperature",
        F.when(F.col("status") == OK, F.col("_number")).alias("rating"),
        "status",
        F.when(F.col("status") != OK, F.col("_line")).alias("line"),
        *origin,
    )


def _lost(value: Column) -> Column:
    """Whether an id is there but is no whole number."""
    return value.isNotNull() & value.try_cast("bigint").isNull()


def parse_answers(
    lines: DataFrame,
    column: str = "value",
    min_rating: float | None = None,
    max_rating: float | None = None,
) -> DataFrame:
    """Ratings of the readable answers only."""
    audited = audit_answers(lines, column, min_rating, max_rating)
    fields = F.struct("movie", "user_id", "movie_id", "temperature", "rating")
    # A plain filter on the status would be pushed below the parsing and repeat it.
    return audited.select(F.inline(F.when(F.col("status") == OK, F.array(fields))))


def audit_counts(audited: DataFrame) -> DataFrame:
    """Lines per status."""
    return audited.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
