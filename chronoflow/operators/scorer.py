"""Fitted scorers over point-in-time features: logistic regression and a small neural network."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from chronoflow.sources.shared import cut, drop


def fit(rows: DataFrame, columns: list[str], hidden: tuple[int, ...] = (), seed: int = 0, steps: int = 100) -> PipelineModel:
    """A model of y (0 or 1) from standardised columns: logistic regression, or with ``hidden`` a perceptron. Columns are
    standardised over all rows. The loss of equal rows is that of one by their number: steps go over the distinct rows, which
    counts of the past have far fewer of. Spark's perceptron takes no weights, so its loss is added up here, from the start
    that Spark draws by the seed, and Spark's model gets the weights that were found. Rows that come as ``distinct_rows``
already, with n_rows, are taken as so many."""
    counted = "n_rows" in rows.columns
    front = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]).fit(_spread(rows, columns) if counted else rows)
    if counted:
        distinct = rows.select(*columns, "y", "n_rows")
    else:
        distinct = distinct_rows(rows, columns)
    if hidden:
        few = front.transform(rows.limit(1))
        unfitted = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[len(columns), *hidden, 2], seed=seed, maxIter=0)
        start = unfitted.fit(few).weights.toArray()
        scaler = front.stages[-1]
        data = cut(distinct.repartition(rows.sparkSession.sparkContext.defaultParallelism))
        best = lbfgs(lambda w: network_loss(data, columns, unfitted.getLayers(), w, scaler.mean.toArray(), scaler.std.toArray()), start, steps)
        drop(data)
        last = unfitted.copy({unfitted.initialWeights: Vectors.dense(best)}).fit(few)
    else:
        last = LogisticRegression(featuresCol="x", labelCol="y", weightCol="n_rows", maxIter=steps).fit(front.transform(distinct))
    return PipelineModel(stages=[*front.stages, last])


def distinct_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of ``columns`` and y with n_rows, how many there are of each."""
    return rows.groupBy(*columns, "y").agg(F.count("*").cast("double").alias("n_rows"))


def _spread(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Two rows with the means and the sample deviations that ``columns`` have over rows with n_rows, which Spark's scaler
    takes no weights for."""
    n = F.col("n_rows")
    mean = rows.agg(F.sum("n_rows").alias("n"), *[(F.sum(F.col(c) * n) / F.sum("n_rows")).alias(c) for c in columns]).first()
    square = lambda c: F.sum(n * (F.col(c) - F.lit(mean[c])) * (F.col(c) - F.lit(mean[c])))
    std = rows.agg(*[F.sqrt(square(c) / max((mean["n"] or 0) - 1, 1)).alias(c) for c in columns]).first()
    # Two values lie half of the root of two deviations from their mean.
    return rows.sparkSession.createDataFrame([tuple(mean[c] + way * std[c] / 2**0.5 for c in columns) for way in (-1.0, 1.0)], ", ".join(f"`{c}` double" for c in columns))


def network_loss(data: DataFrame, columns: list[str], layers: list[int], w: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean cross-entropy of distinct rows with n_rows and its gradient at the weights, each layer's matrix by columns
    and then its constants, as Spark has them. A task adds up its rows; the driver gets a row a task."""
    scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, rows, grad = 0.0, 0.0, np.zeros(len(w))
        for b in batches:
            x = (np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]) - mean) * scale
            y, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n_rows"))
            part, g = _network(x, y.astype(int), n, layers, w)
            loss, rows, grad = loss + part, rows + n.sum(), grad + g
        if rows:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [rows], "grad": [grad.tolist()]})

    parts = data.mapInArrow(added, "loss double, n double, grad array<double>").collect()
    total = sum(r["n"] for r in parts)
    return sum(r["loss"] for r in parts) / total, np.sum([r["grad"] for r in parts], axis=0) / total


def _network(x: np.ndarray, y: np.ndarray, n: np.ndarray, layers: list[int], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and gradient of some rows: sigmoids, and a softmax at the end."""
    at, weights, outs = 0, [], [x]
    for k, (a, b) in enumerate(zip(layers[:-1], layers[1:], strict=True)):
        m, c = w[at : at + a * b].reshape(b, a, order="F"), w[at + a * b : at + a * b + b]
        at += a * b + b
        weights.append(m)
        z = outs[-1] @ m.T + c
        if k < len(layers) - 2:
            outs.append(0.5 * (1 + np.tanh(0.5 * z)))
    z -= z.max(1, keepdims=True)
    log = z - np.log(np.exp(z).sum(1, keepdims=True))
    each = np.arange(len(y))
    loss, delta = -(n * log[each, y]).sum(), np.exp(log)
    delta[each, y] -= 1
    delta *= n[:, None]
    grads = []
    for m, h in zip(weights[::-1], outs[::-1], strict=True):
        grads = [(delta.T @ h).ravel(order="F"), delta.sum(0), *grads]
        delta = (delta @ m) * h * (1 - h)
    return loss, np.concatenate(grads)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 10, tol: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS steps of ``f`` (value and gradient); a step's length is halved until it goes down enough, or
    doubled while the slope is still steep."""
    value, g = f(w)
    past: deque = deque(maxlen=memory)
    for _ in range(steps):
        p, kept = -g, []
        for s, y, rho in reversed(past):
            a = rho * (s @ p)
            p = p - a * y
            kept.append(a)
        if past:
            s, y, rho = past[-1]
            p = p / (rho * (y @ y))
        for (s, y, rho), a in zip(past, reversed(kept), strict=True):
            p = p + s * (a - rho * (y @ p))
        slope = g @ p
        if slope >= 0:
            p, slope = -g, -(g @ g)
            past.clear()
        low, high, t = 0.0, np.inf, 1.0 if past else min(1.0, 1 / np.sqrt(g @ g + 1e-300))
        for _ in range(20):
            new, ng = f(w + t * p)
            if not new <= value + 1e-4 * t * slope:
                high = t
            elif ng @ p < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * t
        if not new < value:
            break
        s, y = t * p, ng - g
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        gain, w, value, g = value - new, w + s, new, ng
        if gain <= tol * 1e-2 * max(abs(value), 1e-3) or np.sqrt(g @ g) <= tol:
            break
    return w


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with score, the probability of y = 1."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("raw", "x", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """The weights of a logistic model by column."""
    return list(zip(columns, (float(v) for v in model.stages[-1].coefficients)))


def labelled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives and negatives in one table with y."""
    return positives.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))
