"""Session factory and lineage cutting."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Return the running session or start one. Stages never stop it: the caller owns it.

    Adaptive execution and its skew joins, which the operators count on, are Spark's defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions_for(input_bytes: int, reduction: float = 1.0, target_mb: int = 200) -> int:
    """Shuffle partitions that keep each at about ``target_mb`` once ``reduction`` of the input is shuffled."""
    return max(8, int(input_bytes * reduction / (target_mb * 1024 * 1024)) + 1)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that the driver and all executors see.

    The one the cluster names in ``spark.checkpoint.dir``, else the context's checkpoint folder, else
    a folder in the warehouse, which is shared by definition. The caller's context is left as it is.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate").rstrip("/")


# A thread's own, and those of the thread that started it where that hands its context on.
_open_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open_scopes", default=())


@contextlib.contextmanager
def intermediate_tables(spark: SparkSession):
    """Remove, at the end of the block, every table that ``new_folder`` named within it.

    For whole stages, whose output is written when the block ends. A query that returns a lazy
    result must not use it, as the result still reads those tables.
    """
    made: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), made))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in made:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, prefix: str = "raterscope") -> str:
    """Name of a folder below the shared one that nothing else uses."""
    path = f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"
    if scopes := _open_scopes.get():
        scopes[-1].append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and continue from the written table. Runs a job.

    Used where a result is read many times (ranks, model folds), so that neither the repeated
    reads nor a lost executor reruns the jobs before it. A table rather than a checkpoint, because
    later reads then see only the columns they use and the planner knows its size. Inside
    ``intermediate_tables`` the table goes when the block ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
