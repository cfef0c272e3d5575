"""Many balanced L2 logistic regressions in one: all feature sets, held-out classes and label seeds share each pass.

The fits differ in their features, rows or labels. A pass over the rows adds up, for every fit, the loss, the
gradient and the packed upper triangle of the Hessian; a task emits one packed block per fit, Spark adds the
blocks, and the driver takes a Newton step from fits x features^2 / 2 numbers. A step that raises the loss is
halved. The number of passes does not grow with the number of fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from busward.functions.columns import logistic
from busward.operators.metrics import best_f1_threshold, confusion, curve, roc_auc, with_rates


@dataclass(frozen=True)
class Fit:
    """A regression on `features` over the rows where `rows` holds, with a 0/1 label."""

    name: str
    features: Sequence[str]
    rows: Column
    label: Column


@dataclass(frozen=True)
class Linear:
    """Weights of the raw features."""

    features: Sequence[str]
    weights: Sequence[float]
    intercept: float

    def probability(self) -> Column:
        return logistic([F.col(f).cast("double") for f in self.features], self.weights, self.intercept)


def _packed(rows: DataFrame, work, length: int) -> dict[int, np.ndarray]:
    """Sums of work(X, Y) -> (fits, length) over all rows, by fit."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for pdf in batches:
            if len(pdf):
                total = total + work(np.stack(pdf["_x"]), np.stack(pdf["_y"]))
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"fit": range(len(total)), "block": list(total)})

    sums = rows.mapInPandas(summed, "fit int, block array<double>").select("fit", F.posexplode("block").alias("at", "value"))
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("fit", "at").agg(F.sum("value").alias("value")).toPandas().itertuples(index=False):
        out.setdefault(r.fit, np.zeros(length))[r.at] = r.value
    return out


def fit_all(df: DataFrame, fits: Sequence[Fit], c: float = 1.0, passes: int = 60, tolerance: float = 1e-8) -> dict[str, Linear]:
    """The fitted models by name. Features are standardized by each fit's own rows (a constant one is left as it is),
    classes weigh n / (2 n_c), the penalty is |w|^2 / 2 with loss weight c; the intercept is free. df is read in every
    pass, so it should be a table. Rows with a null label are in no fit."""
    names = sorted({f for fit in fits for f in fit.features})
    p, size = len(names), len(fits)
    mask = np.array([[f in fit.features for f in names] for fit in fits])
    inside = [F.when(fit.rows & fit.label.isNotNull(), fit.label.cast("double")).otherwise(-1.0) for fit in fits]
    rows = df.select(F.array(*[F.col(f).cast("double") for f in names]).alias("_x"), F.array(*inside).alias("_y"))

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        held = (y >= 0).astype(float).T
        return np.hstack([held.sum(axis=1, keepdims=True), (y == 1).sum(axis=0)[:, None], held @ x, held @ (x * x)])

    found = _packed(rows, moments, 2 + 2 * p)
    if len(found) < len(fits) or any(not 0 < b[1] < b[0] for b in found.values()):
        raise ValueError("every fit needs rows of both classes")
    block = np.stack([found[i] for i in range(len(fits))])
    n, ones = block[:, 0], block[:, 1]
    mean = block[:, 2 : 2 + p] / n[:, None]
    variance = block[:, 2 + p :] / n[:, None] - mean**2
    # Squares leave a rest of the size of the mean's rounding, which is no spread.
    std = np.sqrt(np.where(variance > 1e-12 * np.maximum(mean**2, 1e-300), variance, 1.0))
    weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], axis=1)
    upper = np.triu_indices(p + 1)
    theta = np.zeros((len(fits), p + 1))

    def newton_sums(at: np.ndarray):
        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = []
            for k in range(size):
                own = y[:, k] >= 0
                z = np.hstack([np.ones((own.sum(), 1)), (x[own] - mean[k]) / std[k] * mask[k]])
                label = y[own, k]
                s = c * weight[k][label.astype(int)]
                score = z @ at[k]
                q = 1 / (1 + np.exp(-score))
                loss = (s * (np.logaddexp(0, score) - label * score)).sum()
                hessian = (z * (s * q * (1 - q))[:, None]).T @ z
                out.append(np.concatenate([[loss], z.T @ (s * (q - label)), hessian[upper]]))
            return np.stack(out)
        return work

    last = np.full(len(fits), np.inf)
    step, tried = np.zeros_like(theta), theta.copy()
    done = np.zeros(len(fits), bool)
    small = lambda k: np.abs(step[k]).max() < tolerance * (1 + np.abs(theta[k]).max())
    for _ in range(passes):
        found = _packed(rows, newton_sums(tried), 1 + (p + 1) + len(upper[0]))
        for k in np.flatnonzero(~done):
            loss = found[k][0] + 0.5 * (tried[k, 1:] ** 2).sum()
            if loss > last[k] + 1e-12 * abs(last[k]):
                step[k] /= 2
                tried[k] = theta[k] + step[k]
                done[k] = small(k)
                continue
            theta[k], last[k] = tried[k], loss
            ridge = np.concatenate([[0.0], np.where(mask[k], 1.0, 0.0)])
            gradient = found[k][1 : p + 2] + ridge * theta[k]
            hessian = np.zeros((p + 1, p + 1))
            hessian[upper] = found[k][p + 2 :]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge)
            hessian[np.arange(1, p + 1)[~mask[k]], np.arange(1, p + 1)[~mask[k]]] = 1.0  # features of other fits stay at zero
            step[k] = -np.linalg.solve(hessian, gradient)
            done[k] = small(k)
            tried[k] = theta[k] + step[k]
            if done[k]:  # a last step this small only sharpens the result
                theta[k] = tried[k]
        if done.all():
            break
    out = {}
    for k, fit in enumerate(fits):
        raw = theta[k, 1:] / std[k]
        own = [names.index(f) for f in fit.features]
        out[fit.name] = Linear(tuple(fit.features), [float(raw[i]) for i in own], float(theta[k, 0] - sum(raw[i] * mean[k, i] for i in own)))
    return out


def scored_long(df: DataFrame, models: dict[str, Linear], columns: Sequence[str]) -> DataFrame:
    """columns, fit and attack_probability: one row for each row and model. One matrix product scores a batch for all
    models; as expressions, models times features would outgrow the plan."""
    names = sorted({f for m in models.values() for f in m.features})
    weights = np.zeros((len(names), len(models)))
    for k, m in enumerate(models.values()):
        weights[[names.index(f) for f in m.features], k] = m.weights
    intercepts = np.array([m.intercept for m in models.values()])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["_x"]) if len(pdf) else np.zeros((0, len(names)))
            yield pdf.drop(columns="_x").assign(_p=list(1 / (1 + np.exp(-(x @ weights + intercepts)))))

    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("_p", T.ArrayType(T.DoubleType()))])
    rows = df.select(*columns, F.array(*[F.col(f).cast("double") for f in names]).alias("_x")).mapInPandas(scored, schema)
    fit = F.element_at(F.array(*[F.lit(name) for name in models]), F.col("_k") + 1)
    return rows.select(*columns, F.posexplode("_p").alias("_k", "attack_probability")).select(*columns, fit.alias("fit"), "attack_probability")


def thresholds(scored: DataFrame, truth: str) -> DataFrame:
    """fit, threshold: the lowest threshold of the best F1 of each fit."""
    return best_f1_threshold(curve(scored, ["fit"], truth, "attack_probability"), ["fit"], False).select("fit", "threshold")


def judged(scored: DataFrame, limits: DataFrame, truth: str, keys: Sequence[str] = ("fit",)) -> DataFrame:
    """Counts, rates, AUC and threshold of each fit (and further keys); a score at its threshold is an alarm."""
    keys = list(keys)
    rows = scored.join(limits, "fit").withColumn("_alarm", (F.col("attack_probability") >= F.col("threshold")).cast("int"))
    counts = with_rates(confusion(rows, keys, truth, {"linear": "_alarm"})).drop("method")
    auc = roc_auc(scored, keys, truth, "attack_probability").select(*keys, "roc_auc")
    return counts.join(auc, keys, "left").join(limits, "fit")
