"""The classifiers that are compared: boosted trees (``boosting``), random forests (``forest``), support vectors (``kernel``) and Spark ML pipelines.

The parameters are those of the libraries usually used for these models on small tables. Neighbours are in ``knn``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from ..schemas import CORE_FEATURES
from .boosting import BoostedTrees
from .forest import RandomForest
from .kernel import KernelSvm

SEED = 42
# Builds the pipeline for a label column, feature columns and number of training rows.
Builder = Callable[[str, Sequence[str], int], Pipeline]


def assembler(features: Sequence[str] = CORE_FEATURES, handle_invalid: str = "keep") -> VectorAssembler:
    """Feature vector; undefined features pass as NaN and their scores are masked when scoring."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=handle_invalid)


def boosted_trees(rounds: int = 100, **parameters) -> BoostedTrees:
    """Trees with L1 0.1 and L2 1.0, depth 6 and rate 0.3; all folds and steps grow together."""
    return BoostedTrees(rounds, **parameters)


def random_forest(trees: int = 100, depth: int = 30) -> RandomForest:
    """``depth`` is the most that Spark allows; trees usually end before. Many features go to Spark's own forest."""

    def build(label: str, features: Sequence[str], n_rows: int) -> Pipeline:
        forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)
        return Pipeline(stages=[assembler(features), forest])

    return RandomForest(trees, depth, SEED, build)


def support_vectors(iterations: int = 20, **parameters) -> KernelSvm:
    """A radial kernel, penalty 1 and calibrated probabilities; all folds are fitted together."""
    return KernelSvm(iterations, **parameters)


def logistic_regression(iterations: int = 1000, standardize: bool = False) -> Builder:
    """Unit penalty on the summed loss, which is 1/n on Spark's mean loss."""

    def build(label: str, features: Sequence[str], n_rows: int) -> Pipeline:
        regression = LogisticRegression(
            labelCol=label,
            maxIter=iterations,
            regParam=1.0 / max(n_rows, 1),
            standardization=standardize,
        )
        return Pipeline(stages=[assembler(features), regression])

    return build


def builders(rounds: int = 100, trees: int = 100, svm_iterations: int = 20) -> dict[str, Builder | BoostedTrees | KernelSvm | RandomForest]:
    """The fitted models of the comparison by name."""
    return {
        "boosted_trees": boosted_trees(rounds),
        "random_forest": random_forest(trees),
        "support_vectors": support_vectors(svm_iterations),
        "logistic_regression": logistic_regression(),
    }
