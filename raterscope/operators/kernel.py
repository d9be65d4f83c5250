"""Support vectors with a radial kernel and calibrated probabilities, the models of all folds together.

The kernel ``exp(-gamma * |x - y|^2)`` of standardised features is the mean of products of random cosines, so a row
becomes ``components`` of them (random Fourier features, drawn from a fixed seed) and the model is linear in
these: ``|w|^2 / 2 + penalty * sum(max(0, 1 - y * margin)^2)``, the squared hinge, which Newton steps minimise. A
step is one job for all models: tasks sum gradients and second derivatives, whose size depends on the components only, and
the driver solves one small system a model.

Probabilities are a sigmoid of the margin (Platt). Its two numbers are fitted on margins of rows that the scoring model has
not seen: beside each fold's model stand ``inner`` others, each without a hashed part of the rows, for that part's margins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, intermediate_tables

_CALIBRATION_STEPS = 12


@dataclass(frozen=True)
class KernelModel:
    """Standardised features, cosines (frequencies and phase), weights, and the sigmoid's slope and shift."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    frequencies: tuple[tuple[float, ...], ...]
    phases: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float

    def margin(self) -> Column:
        """The margin as one native expression over the feature columns."""
        row = F.array(*[(F.col(f"`{f}`").cast("double") - m) / s for f, m, s in zip(self.features, self.means, self.scales, strict=True)])
        height = float(np.sqrt(2.0 / len(self.weights)))
        terms = F.array(
            *[
                F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(p).alias("p"), F.lit(height * v).alias("v"))
                for w, p, v in zip(self.frequencies, self.phases, self.weights, strict=True)
            ]
        )

        def term(total: Column, t: Column) -> Column:
            turn = F.aggregate(F.zip_with(t["w"], row, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
            return total + t["v"] * F.cos(turn + t["p"])

        return F.aggregate(terms, F.lit(self.bias), term)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the calibrated probability of class 1, and ``prediction``."""
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(self.slope) * self.margin() + F.lit(self.shift)))
        return df.withColumn("score", score).withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        terms = [(i, list(w), p, v) for i, (w, p, v) in enumerate(zip(self.frequencies, self.phases, self.weights, strict=True))]
        spark.createDataFrame(terms, "place int, w array<double>, p double, v double").coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
        row = [(list(self.features), list(self.means), list(self.scales), self.bias, self.slope, self.shift)]
        schema = "features array<string>, means array<double>, scales array<double>, bias double, slope double, shift double"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KernelModel:
        head = spark.read.parquet(f"{path}/head").first()
        terms = spark.read.parquet(f"{path}/terms").orderBy("place").collect()
        columns = [tuple(head[c]) for c in ("features", "means", "scales")]
        return KernelModel(
            *columns, tuple(tuple(t["w"]) for t in terms), tuple(t["p"] for t in terms), tuple(t["v"] for t in terms),
            head["bias"], head["slope"], head["shift"],
        )


@dataclass(frozen=True)
class _Plan:
    """What a task needs: cosines, each fold's standardisation, and the weights of every model so far."""

    features: tuple[str, ...]
    folds: tuple[int, ...]
    means: np.ndarray
    scales: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # (fold, model, component and bias); model 0 sees all parts, model j not part j - 1

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each fold in the batch: its place, the rows' cosines with a one behind, signs and parts."""
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        held_out, sign, part = column("held_out"), 2.0 * column("label") - 1.0, column("part")
        values = np.stack([column(f) for f in self.features], axis=1)
        for fold in np.unique(held_out).tolist():
            own = held_out == fold
            place = self.folds.index(fold)
            angles = (values[own] - self.means[place]) / self.scales[place] @ self.frequencies.T + self.phases
            cosines = np.sqrt(2.0 / len(self.phases)) * np.cos(angles)
            yield place, np.concatenate([cosines, np.ones((len(cosines), 1))], axis=1), sign[own], part[own]


def _sums(plan: _Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gradient and second derivatives of the loss for every model, as (key, value) with sums in the order of the models."""
    n_folds, n_models, width = plan.weights.shape
    upper = np.triu_indices(width)
    sums = np.zeros((n_folds, n_models, width + len(upper[0])))
    for batch in batches:
        for place, rows, sign, part in plan.read(batch):
            for model in range(n_models):
                gap = 1.0 - sign * (rows @ plan.weights[place, model])
                used = (gap > 0) & (part != model - 1)
                active = rows[used]
                sums[place, model, :width] -= 2.0 * (sign[used] * gap[used]) @ active
                sums[place, model, width:] += 2.0 * (active.T @ active)[upper]
    flat = sums.ravel()
    keys = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flat[keys])], ["key", "value"])


def _unseen_margins(plan: _Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place, rows, sign, part in plan.read(batch):
            margins = np.einsum("nd,nd->n", rows, plan.weights[place, part + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), place, np.int32)), pa.array((sign > 0).astype(np.float64)), pa.array(margins)], ["fold", "label", "margin"]
            )


@dataclass(frozen=True)
class KernelSvm:
    """Parameters. ``gamma`` is one over the number of features where it is not given."""

    steps: int = 20
    components: int = 128
    penalty: float = 1.0
    gamma: float | None = None
    inner: int = 3
    seed: int = 42

    def cosines(self, n_features: int) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies and phases of the random features."""
        rng = np.random.default_rng(self.seed)
        gamma = 1.0 / n_features if self.gamma is None else self.gamma
        return rng.standard_normal((self.components, n_features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, self.components)

    def fit_together(self, rows: DataFrame, features: Sequence[str], folds: Sequence[int], n_rows: int) -> dict[int, KernelModel]:
        """A model for each fold, trained on the rows with ``held_out`` = fold. ``rows`` has ``label``, the features and ``held_out``.

        Runs a job a step; its tables are removed.
        """
        with intermediate_tables(rows.sparkSession):
            return self._fitted(rows, tuple(features), tuple(folds))

    def _fitted(self, rows: DataFrame, features: tuple[str, ...], folds: tuple[int, ...]) -> dict[int, KernelModel]:
        named = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
        part = F.pmod(F.xxhash64(*named, F.lit(self.seed)), F.lit(self.inner)).cast("int").alias("part")
        rows = cut_lineage(rows.select(F.col("label").cast("double").alias("label"), *named, F.col("held_out").cast("int").alias("held_out"), part))
        spread = rows.groupBy("held_out").agg(*[x for f in features for x in (F.avg(f"`{f}`"), F.stddev_pop(f"`{f}`"))])
        found = {r[0]: np.array(r[1:], np.float64).reshape(-1, 2) for r in spread.collect()}
        neutral = np.array([[0.0, 1.0]] * len(features))
        table = np.stack([found.get(fold, neutral) for fold in folds])
        scales = np.where(table[:, :, 1] > 0, table[:, :, 1], 1.0)
        frequencies, phases = self.cosines(len(features))
        weights = np.zeros((len(folds), self.inner + 1, self.components + 1))
        plan = _Plan(features, folds, table[:, :, 0], scales, frequencies, phases, weights)
        for _ in range(self.steps):
            if not self._step(plan, rows):
                break
        sigmoids = _sigmoids(cut_lineage(rows.mapInArrow(partial(_unseen_margins, plan), "fold int, label double, margin double")), len(folds))
        as_floats = lambda values: tuple(map(float, values))
        return {
            fold: KernelModel(
                features, as_floats(plan.means[i]), as_floats(scales[i]), tuple(map(as_floats, frequencies)), as_floats(phases),
                as_floats(weights[i, 0, :-1]), float(weights[i, 0, -1]), *sigmoids[i],
            )
            for i, fold in enumerate(folds)
        }

    def _step(self, plan: _Plan, rows: DataFrame) -> bool:
        """One Newton step of every model; whether any still moved. Runs a job."""
        n_folds, n_models, width = plan.weights.shape
        sums = rows.mapInArrow(partial(_sums, plan), "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
        dense = np.zeros(n_folds * n_models * (width + width * (width + 1) // 2))
        dense[sums.column("key").to_numpy()] = sums.column("value").to_numpy()
        dense = dense.reshape(n_folds * n_models, -1)
        upper, moved = np.triu_indices(width), False
        # The bias is not penalised, but held by a trace, so that a model without rows stays at zero.
        ridge = np.ones(width)
        ridge[-1] = 1e-9
        for i, weights in enumerate(plan.weights.reshape(-1, width)):
            curve = np.zeros((width, width))
            curve[upper] = dense[i, width:]
            curve = self.penalty * (curve + np.triu(curve, 1).T) + np.diag(ridge)
            change = np.linalg.solve(curve, self.penalty * dense[i, :width] + ridge * weights)
            plan.weights.reshape(-1, width)[i] -= change
            moved |= bool(np.abs(change).max() > 1e-9)
        return moved


def _sigmoids(margins: DataFrame, folds: int) -> list[tuple[float, float]]:
    """Slope and shift of each fold's sigmoid ``1 / (1 + exp(slope * margin + shift))``, by Newton steps. Runs a job each.

    Labels are drawn in by one row of either class, as Platt has it, so that separable margins have a finite slope.
    """
    counts = {r["fold"]: (r["p"], r["n"]) for r in margins.groupBy("fold").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    found = np.zeros((folds, 2))
    targets = np.zeros((folds, 2))
    for i in range(folds):
        positive, n = counts.get(i, (0.0, 0))
        targets[i] = 1.0 / (n - positive + 2.0), (positive + 1.0) / (positive + 2.0)
        found[i] = 0.0, np.log((n - positive + 1.0) / (positive + 1.0))
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("fold") + 1)
    for _ in range(_CALIBRATION_STEPS):
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(at(found[:, 0]) * F.col("margin") + at(found[:, 1])))
        target = F.when(F.col("label") > 0, at(targets[:, 1])).otherwise(at(targets[:, 0]))
        rows = margins.select("fold", F.col("margin").alias("m"), (target - chance).alias("d"), (chance * (F.lit(1.0) - chance)).alias("c"))
        sums = rows.groupBy("fold").agg(
            *[F.sum(F.expr(e)).alias(f"s{i}") for i, e in enumerate(("d * m", "d", "c * m * m", "c * m", "c"))]
        )
        change = 0.0
        for fold, dm, d, cmm, cm, c in sums.collect():
            step = np.linalg.solve(np.array([[cmm + 1e-12, cm], [cm, c + 1e-12]]), np.array([dm, d]))
            found[fold] -= np.clip(step, -5.0, 5.0)
            change = max(change, float(np.abs(step).max()))
        if change < 1e-10:
            break
    return [(float(a), float(b)) for a, b in found]
