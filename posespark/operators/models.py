"""Posture models and predictors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut


#: Added to the diagonal of covariances, so that a component of few points stays a density; least gain of the mean likelihood to go on.
RIDGE, TOLERANCE = 1e-6, 1e-4


@dataclass
class Mixture:
    """Parameters of a Gaussian mixture of full covariance, and where its fit stands."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float = float("-inf")
    steps: int = 0
    done: bool = False

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Weighted log density of each point under each component."""
        out = np.empty((len(x), len(self.weights)))
        for c, (w, m, v) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(v)
            z = np.linalg.solve(root, (x - m).T)
            out[:, c] = np.log(max(w, 1e-300)) - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def criterion(self) -> float:
        k, d = self.means.shape
        return 2 * (k - 1 + k * d + k * d * (d + 1) // 2) - 2 * self.likelihood


def _statistics(models: dict[int, Mixture]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sufficient statistics of all models over a task's points: model, component, and a list of weight, sums, products and likelihood."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(float)
            for name, model in models.items():
                logs = model.log_densities(x)
                top = logs.max(axis=1, keepdims=True)
                each = np.exp(logs - top)
                total = each.sum(axis=1, keepdims=True)
                each /= total
                likelihood = float((top + np.log(total)).sum())
                for c in range(each.shape[1]):
                    r = each[:, c]
                    parts = np.concatenate([[r.sum()], r @ x, ((x * r[:, None]).T @ x).ravel(), [likelihood if c == 0 else 0.0]])
                    totals[name, c] = totals.get((name, c), 0.0) + parts
        yield pd.DataFrame([(m, c, t.tolist()) for (m, c), t in totals.items()], columns=["model", "component", "parts"])

    return run


def _starts(points: DataFrame, ks: Sequence[int], seeds: Sequence[int]) -> dict[tuple[int, int], Mixture]:
    """For each (k, seed) k points of least hash as means and the spread of all points as covariance; each task sends max(ks) points a seed."""
    most = max(ks)
    hashed = points.select("v", F.posexplode(F.array(*[F.xxhash64(F.lit(s), "v") for s in seeds])).alias("seed", "h")).distinct()
    order = Window.partitionBy("seed").orderBy("h", "v")
    part = Window.partitionBy("seed", "_task").orderBy("h", "v")
    near = hashed.withColumn("_task", F.spark_partition_id()).withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= most)
    chosen: dict[int, list] = {}
    for r in near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).orderBy("seed", "_n").collect():  # max(ks) rows a seed
        chosen.setdefault(r["seed"], []).append(r["v"])
    dims = len(next(iter(chosen.values()))[0])
    whole = Mixture(np.ones(1), np.zeros((1, dims)), np.eye(dims)[None])
    parts = _summed(points, {0: whole})[0][0]
    mean = parts[1 : 1 + dims] / parts[0]
    spread = parts[1 + dims : -1].reshape(dims, dims) / parts[0] - np.outer(mean, mean) + RIDGE * np.eye(dims)
    out = {}
    for k in ks:
        for i, seed in enumerate(seeds):
            means = np.array((chosen[i] * k)[:k], float)
            out[k, seed] = Mixture(np.full(k, 1 / k), means, np.repeat(spread[None], k, axis=0))
    return out


def _summed(points: DataFrame, models: dict[int, Mixture]) -> dict[int, np.ndarray]:
    """Per model the statistics of its components over all points; a number for each statistic reaches the driver, whatever the number of points."""
    stats = points.mapInPandas(_statistics(models), "model int, component int, parts array<double>")
    rows = stats.select("model", "component", F.posexplode("parts").alias("at", "value")).groupBy("model", "component", "at").agg(F.sum("value").alias("value"))
    size = {i: (len(m.weights), 2 + m.means.shape[1] + m.means.shape[1] ** 2) for i, m in models.items()}
    out = {i: np.zeros(s) for i, s in size.items()}
    for r in rows.collect():
        out[r["model"]][r["component"], r["at"]] = r["value"]
    return out


def sweep_mixtures(modes: DataFrame, column: str, ks: Sequence[int], seeds: Sequence[int] = (0,), max_iter: int = 50) -> dict[tuple[int, int], Mixture]:
    """Gaussian mixtures of full covariance for all numbers of components and all seeds, fitted together.

    A step is one job over the points: every task adds up the sufficient statistics of all models that still gain, a row for each of their
    components, and these small rows are summed. Points with a null or missing number are left out; of fewer distinct points than components some
    means start in one place. An empty table gives no models.
    """
    good = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    points = cut(modes.select(F.transform(column, lambda x: x.cast("double")).alias("v")).filter(good))
    if points.isEmpty():
        return {}
    models = _starts(points, ks, seeds)
    names = list(models)
    for _ in range(max_iter):
        going = {i: models[n] for i, n in enumerate(names) if not models[n].done}
        if not going:
            break
        found = _summed(points, going)
        for i, model in going.items():
            dims = model.means.shape[1]
            parts = found[i]
            n, likelihood = parts[:, 0], float(parts[:, -1].sum())
            gain = (likelihood - model.likelihood) / n.sum()
            model.likelihood, model.steps = likelihood, model.steps + 1
            if gain < TOLERANCE:
                model.done = True
                continue
            held = np.maximum(n, 1e-12)[:, None]
            model.weights, model.means = n / n.sum(), parts[:, 1 : 1 + dims] / held
            products = parts[:, 1 + dims : -1].reshape(-1, dims, dims) / held[:, :, None]
            model.covariances = products - model.means[:, :, None] * model.means[:, None, :] + RIDGE * np.eye(dims)
    return models


def fit_mixture(modes: DataFrame, column: str, k: int, seed: int = 0, max_iter: int = 50) -> DataFrame:
    """component, weight, mean, covariance of a Gaussian mixture, in curvature order of the means."""
    models = sweep_mixtures(modes, column, [k], [seed], max_iter)
    rows = [(float(w), m.tolist(), v.tolist()) for model in models.values() for w, m, v in zip(model.weights, model.means, model.covariances)]
    rows.sort(key=lambda r: sum(abs(b - a) for a, b in zip(r[1], r[1][1:], strict=False)))
    return modes.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "component int, weight double, mean array<double>, covariance array<array<double>>")


def information_criterion(modes: DataFrame, column: str, ks: Sequence[int], seeds: Sequence[int] = (0,), max_iter: int = 50) -> list[tuple[int, int, float]]:
    """(k, seed, AIC) of mixtures of full covariance, all fitted in the same passes."""
    return [(k, seed, model.criterion()) for (k, seed), model in sweep_mixtures(modes, column, ks, seeds, max_iter).items()]


def criterion_spread(criteria: DataFrame) -> DataFrame:
    """k, n, mean and (population) deviation of the AIC over the seeds; NaN fits are left out."""
    known = F.when(~F.isnan("aic"), F.col("aic"))
    return criteria.groupBy("k").agg(F.count(known).alias("n"), F.avg(known).alias("mean_aic"), F.stddev_pop(known).alias("deviation"))


def sample_postures(spark: SparkSession, n: int, weights: Sequence[float], means: Sequence[Sequence[float]], covariances: Sequence, seed: int = 0) -> DataFrame:
    """id and theta of n postures: a component by weight, a normal draw, a turn of the whole body.

    Each row's generator is seeded by (seed, id), so partitions do not matter.
    """
    roots = [np.linalg.cholesky(np.asarray(c, float) + 1e-12 * np.eye(len(c))) for c in covariances]
    share = np.cumsum(np.asarray(weights, float) / np.sum(weights))
    centres = np.asarray(means, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            thetas = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                c = min(int(np.searchsorted(share, rng.random())), len(roots) - 1)
                turn = rng.random() * 2 * np.pi
                thetas.append((centres[c] + roots[c] @ rng.standard_normal(centres.shape[1]) + turn).tolist())
            yield pd.DataFrame({"id": batch["id"], "theta": thetas})

    return spark.range(n).mapInPandas(run, "id long, theta array<double>")


def predictor(make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 512, input_shape: Sequence[int] | None = None) -> Callable[[Column], Column]:
    """A function of image columns around any model: make() loads it once a worker."""
    return predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[list(input_shape)] if input_shape else None)


def nearest_posture(images: np.ndarray, thetas: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A baseline model: the posture whose image, centred and scaled, is most alike."""
    flat = images.reshape(len(images), -1).astype(float)
    flat -= flat.mean(axis=1, keepdims=True)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def predict(batch: np.ndarray) -> np.ndarray:
            rows = batch.reshape(len(batch), -1).astype(float)
            rows -= rows.mean(axis=1, keepdims=True)
            return thetas[np.argmax(rows @ flat.T, axis=1)]

        return predict

    return make
