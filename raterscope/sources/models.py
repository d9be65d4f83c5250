"""Fitted pipelines on disk."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.boosting import BoostedModel
from ..operators.forest import ForestModel
from ..operators.kernel import KernelModel
from ..operators.validation import Model, NativeModel


def model_name(prefix: str = "rater_model", day: date | None = None) -> str:
    """Name that carries the date of training."""
    return f"{prefix}_{(day or date.today()).isoformat()}"


def save_model(model: Model, folder: str, prefix: str = "rater_model", day: date | None = None) -> str:
    """Save under a dated name in ``folder`` and return the path."""
    path = f"{folder.rstrip('/')}/{model_name(prefix, day)}"
    if isinstance(model, NativeModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> Model:
    """Load a model saved by :func:`save_model`: tables of nodes, of kernel terms or of cells, or a pipeline."""
    spark, path = SparkSession.active(), path.rstrip("/")
    for folder, kind in (("nodes", BoostedModel), ("terms", KernelModel), ("grid", ForestModel)):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return kind.load(spark, path)
    return PipelineModel.load(path)
