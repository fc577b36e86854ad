"""A feed-forward network for regression: shards of rows learn side by side and are averaged each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize, HasWeightCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import durable


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of a flat vector as (weights, bias) of each layer."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What goes into each layer, and what leaves the last."""
    passed = [x]
    for i, (w, b) in enumerate(layers):
        z = passed[-1] @ w + b
        passed.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    return passed


def gradient(flat: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of half the mean squared error, rows counted by their weights."""
    layers, out = _layers(flat, sizes), np.zeros_like(flat)
    passed, slots = _forward(x, layers), _layers(out, sizes)
    back = ((passed[-1][:, 0] - y) * weight / max(weight.sum(), 1e-12))[:, None]
    for i in range(len(layers) - 1, -1, -1):
        slots[i][0][:] = passed[i].T @ back
        slots[i][1][:] = back.sum(0)
        back = (back @ layers[i][0].T) * (passed[i] > 0)
    return out


def _finite(x: Column) -> Column:
    return F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))


class _Shared(HasFeaturesCol, HasPredictionCol):
    layers = Param(Params._dummy(), "layers", "sizes of all layers, the features' first", TypeConverters.toListInt)


class NeuralRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol, HasSeed, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """Hidden layers of rectified units on standardised features and label, squared error.

    Rows are dealt evenly into as many shards as there are shuffle partitions, fewer where that
    would leave a shard under ``rowsPerShard`` rows, and written once. A round is a job: each shard
    goes once through its rows in batches by Adam, as they stream by, from the common state; the
    states (weights and both moments) are averaged by rows, in Spark. What comes to the driver has
    the size of the network. Rows without a label, or with a feature that is not finite, do not
    train; without any rows fitting is an error. The same input partitions give the same model.
    """

    hiddenLayers = Param(Params._dummy(), "hiddenLayers", "sizes of the hidden layers", TypeConverters.toListInt)
    batchRows = Param(Params._dummy(), "batchRows", "rows a step", TypeConverters.toInt)
    rowsPerShard = Param(Params._dummy(), "rowsPerShard", "rows a shard has at least", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", weightCol: str | None = None, hiddenLayers: list[int] | None = None, maxIter: int = 20, stepSize: float = 0.01, batchRows: int = 64, rowsPerShard: int = 4096, seed: int = 0) -> None:
        super().__init__()
        self._setDefault(hiddenLayers=[128, 64], maxIter=20, stepSize=0.01, batchRows=64, rowsPerShard=4096, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> NeuralRegressionModel:
        label, weight = F.col(self.getLabelCol()).cast("double"), F.col(self.getWeightCol()).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), label.alias("y"), weight.alias("w"), F.col(self.getFeaturesCol()).alias("v"))
        rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0) & _finite(F.col("x")))
        if rows.isEmpty():
            raise ValueError("no rows to train on")
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), Summarizer.metrics("mean", "std").summary(F.col("v")).alias("f")).first()
        centre, spread = np.array(stats["f"]["mean"].toArray()), np.array(stats["f"]["std"].toArray())
        spread[spread == 0] = 1.0
        mean, scale = stats["m"], stats["s"] or 1.0
        sizes = [len(centre), *self.getOrDefault("hiddenLayers"), 1]
        draw, batch, rate, rounds = np.random.default_rng(self.getSeed()), self.getOrDefault("batchRows"), self.getStepSize(), self.getMaxIter()
        flat = np.concatenate([np.concatenate([draw.normal(0, (2 / max(a, 1)) ** 0.5, a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])
        most = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, min(most, stats["n"] // self.getOrDefault("rowsPerShard")))
        fixed = durable(rows.select("x", "y", "w").repartition(shards))
        state, steps = np.concatenate([flat, np.zeros(2 * len(flat))]), 0.0
        for k in range(rounds):
            step = rate * 0.5 * (1 + np.cos(np.pi * k / rounds))

            def learn(parts: Iterator[pa.RecordBatch], state=state, steps=steps, step=step) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                w, m, v = (a.copy() for a in np.split(state, 3))
                t, n = steps, 0
                for part in parts:
                    x = (part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) - centre) / spread
                    y, weights = (part.column(1).to_numpy(zero_copy_only=False) - mean) / scale, part.column(2).to_numpy(zero_copy_only=False)
                    n += len(y)
                    for i in range(0, len(y), batch):
                        g = gradient(w, sizes, x[i : i + batch], y[i : i + batch], weights[i : i + batch])
                        t += 1
                        m = 0.9 * m + 0.1 * g
                        v = 0.999 * v + 0.001 * g * g
                        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                if n:
                    yield pa.RecordBatch.from_pydict({"state": [np.concatenate([w, m, v, [t]])], "n": pa.array([n], pa.int64())})

            learned = fixed.mapInArrow(learn, "state array<double>, n long").select("n", F.posexplode("state").alias("at", "value"))
            mean_state = learned.groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
            got = mean_state.toPandas().sort_values("at")["value"].to_numpy()  # as long as three networks
            state, steps = got[:-1], float(got[-1])
        flat = state[: len(flat)].copy()
        first, last = _layers(flat, sizes)[0], _layers(flat, sizes)[-1]
        first[0][:] = first[0] / spread[:, None]  # so that the model takes plain features and gives plain values
        first[1][:] = first[1] - centre @ first[0]
        last[0][:] = last[0] * scale
        last[1][:] = last[1] * scale + mean
        model = NeuralRegressionModel()
        model._set(layers=sizes, weights=flat.tolist(), featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model


class NeuralRegressionModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """What ``NeuralRegressor`` learned. A row with a feature that is not finite gets null."""

    weights = Param(Params._dummy(), "weights", "weights and biases, layer by layer", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, flat = self.getOrDefault("layers"), np.array(self.getOrDefault("weights"))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=float)
            rows = np.stack(x.to_numpy())
            out = _forward(np.nan_to_num(rows, posinf=0.0, neginf=0.0), _layers(flat, sizes))[-1][:, 0]
            return pd.Series(np.where(np.isfinite(rows).all(1), out, np.nan))

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(F.col(self.getFeaturesCol()))))
