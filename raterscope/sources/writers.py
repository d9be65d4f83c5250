"""File sinks. All overwrite, and all keep the output parallel unless one file is asked for."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import QUOTE


def run_id(now: datetime | None = None) -> str:
    """Time stamp for output names."""
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")


def _parts(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def write_csv(df: DataFrame, path: str, single_file: bool = False, keep_breaks: bool = True) -> None:
    """CSV with a header. ``single_file`` funnels all rows through one task: small tables only.

    Without ``keep_breaks`` line breaks in text become a space, so that readers can split the file.
    """
    if not keep_breaks:
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        df = df.withColumns({c: F.regexp_replace(c, r"[\r\n]+", " ") for c in texts})
    writer = _parts(df, single_file).write.mode("overwrite")
    writer.options(header=True, quote=QUOTE, escape=QUOTE).csv(path)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", single_file: bool = False) -> None:
    """Parquet with the given codec (``uncompressed`` to match unpacked files)."""
    _parts(df, single_file).write.mode("overwrite").option("compression", codec).parquet(path)


def write_ndjson(lines: DataFrame, path: str) -> None:
    """One text column, already JSON, as one line per row."""
    lines.write.mode("overwrite").text(path)
