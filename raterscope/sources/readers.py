"""File sources with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import require_columns
from ..schemas import RATINGS, STATISTICS, USER_STATISTICS

CORRUPT = "_corrupt_record"
# Quotes inside quoted cells are doubled, as most programs write them.
QUOTE = '"'


def read_ratings_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = RATINGS,
    keep_corrupt: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Ratings from CSV files with a header line.

    Columns are found by their header names and typed by ``schema``; every file must have the
    same header. Passing ``schema=None`` infers the types, which reads the files once more and may
    turn an id column into doubles. Cells that do not fit become null; ``keep_corrupt`` adds the
    raw text of such lines. ``multi_line`` reads titles with line breaks, one file per task.
    """
    options = {"header": True, "quote": QUOTE, "escape": QUOTE, "multiLine": multi_line}
    if schema is None:
        return spark.read.options(**options, inferSchema=True).csv(path)
    header = spark.read.options(**options).csv(path)
    require_columns(header, schema.names)
    typed = {f.name: f for f in schema}
    fields = [typed.get(name, T.StructField(name, T.StringType(), True)) for name in header.columns]
    wanted = list(schema.names)
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
        wanted.append(CORRUPT)
    reader = spark.read.options(
        **options, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    return reader.schema(T.StructType(fields)).csv(path).select(*wanted)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a table read with ``keep_corrupt``: its good rows, and the raw text of the others."""
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad).select(F.col(CORRUPT).alias("line"))


def read_upload_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of unknown columns, named by its header, all read as text.

    Nothing is inferred, so ids keep their spelling and the file is read once; scoring casts the
    rating column itself.
    """
    return spark.read.options(header=True, quote=QUOTE, escape=QUOTE).csv(path)


def read_stats_csv(
    spark: SparkSession, path: str, features: Sequence[str] = STATISTICS
) -> DataFrame:
    """Rater statistics from CSV, columns matched to the schema by their header names.

    The two sources may hold the columns in different order, so the cells are read as text by
    name and then cast.
    """
    return split_broken_cells(read_stats_text(spark, path, features), keep_all=True)[0]


def read_stats_text(spark: SparkSession, path: str, features: Sequence[str] = STATISTICS) -> DataFrame:
    """The same cells as they are written, as text."""
    named = read_upload_csv(spark, path)
    wanted = ["user_id", *features]
    require_columns(named, wanted)
    return named.select(*wanted)


def split_broken_cells(text: DataFrame, keep_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed rows whose cells are numbers or empty, and the text of the other rows.

    With ``keep_all`` all rows are typed, and cells that are no numbers become null.
    """
    kinds = {name: USER_STATISTICS[name].dataType for name in text.columns}
    typed = {name: F.col(name).try_cast(kind) for name, kind in kinds.items()}
    broken = F.lit(False)
    for name, value in typed.items():
        broken = broken | ((F.trim(name) != "") & value.isNull())
    broken = F.coalesce(broken, F.lit(False))
    good = text if keep_all else text.filter(~broken)
    return good.select(*[value.alias(name) for name, value in typed.items()]), text.filter(broken)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(path)


def read_ndjson(spark: SparkSession, prefix: str) -> DataFrame:
    """Every line of every file under a prefix, with the file it came from.

    Lines stay raw text so that broken ones can be counted. A folder without files gives no rows.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(prefix)
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"))
