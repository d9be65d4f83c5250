"""Answer files parsed as they arrive.

Answers come as files added under a prefix while a batch of requests is being worked on. The
file source remembers which files were read, so each run parses only new ones. Parsing and
auditing look at one line at a time. An answer may come twice, in a file that was delivered again or
because its request was sent again; which pairs of rater and title were answered is keyed state, which a
watermark on the files' times bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.answers import OK, audit_answers


def stream_answer_lines(spark: SparkSession, prefix: str, max_files: int | None = None) -> DataFrame:
    """Raw lines of all present and future files under a prefix."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(prefix)


def ingest_answers(
    spark: SparkSession,
    prefix: str,
    out: str,
    progress: str,
    min_rating: float | None = None,
    max_rating: float | None = None,
    max_files: int | None = 1000,
) -> StreamingQuery:
    """Append the audited answers of all new files to Parquet, partitioned by status, and end.

    Run it again, or on a schedule, for files that came later. ``progress`` is the folder of the
    stream's checkpoint; with it the Parquet sink writes every line exactly once.
    """
    audited = audit_answers(
        stream_answer_lines(spark, prefix, max_files), "value", min_rating, max_rating
    )
    return (
        audited.writeStream.format("parquet")
        .partitionBy("status")
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )


def ingest_ratings(
    spark: SparkSession,
    prefix: str,
    out: str,
    progress: str,
    min_rating: float | None = None,
    max_rating: float | None = None,
    max_files: int | None = 1000,
    remember: str = "7 days",
) -> StreamingQuery:
    """Append the ratings of all new files to Parquet, one for each rater and title, and end.

    The first answer that is read counts; later ones of the same rater and title are dropped while it is remembered: for
    ``remember`` after the time of its file, by the newest file seen. State is kept for answered pairs only, dealt out
    by their keys, and is part of the checkpoint in ``progress``: a restart goes on with it. For lines that gave no rating see
    ``ingest_answers``.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(prefix).select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    wrapped = audit_answers(lines, "value", min_rating, max_rating, carry=["arrived"])
    # As in ``parse_answers``: a plain filter on the status would repeat the parsing.
    fields = F.struct("movie", "user_id", "movie_id", "temperature", "rating", "arrived")
    rated = wrapped.select(F.inline(F.when(F.col("status") == OK, F.array(fields))))
    once = rated.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["user_id", "movie_id"])
    return (
        once.writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
