"""Regressions fitted together equal single fits by plain Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from busward.operators.linear_fits import Fit, fit_all, scored_long

NAMES = ("a", "b", "c")


def plain_fit(x, y, passes=100):
    """Balanced L2 logistic regression on standardized columns; raw weights and intercept."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    theta, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(passes):
        q = 1 / (1 + np.exp(-z @ theta))
        theta = theta - np.linalg.solve((z * (s * q * (1 - q))[:, None]).T @ z + ridge, z.T @ (s * (q - y)) + ridge @ theta)
    return theta[1:] / std, theta[0] - (theta[1:] / std * mean).sum()


def test_fits_equal_single_ones(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(400, 3)) * [1, 50, 0.01] + [5, -300, 0]
    y = (x @ [1.5, 0.02, 60] + dice.normal(size=400) > 1).astype(int)
    other = dice.integers(0, 2, 400)
    group = np.arange(400) % 4
    rows = [(int(g), int(a), int(b), *map(float, r), 7.0) for g, a, b, r in zip(group, y, other, x)] + [(0, None, 1, 0.0, 0.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "g int, y int, other int, a double, b double, c double, same double").repartition(7)
    fits = [Fit("all", NAMES, F.lit(True), F.col("y")), Fit("two", ("c", "a"), F.lit(True), F.col("y")), Fit("part", NAMES, F.col("g") != 2, F.col("y")),
            Fit("noise", NAMES, F.col("y").isNotNull(), F.col("other")), Fit("constant", ("a", "same"), F.lit(True), F.col("y"))]
    found = fit_all(df, fits)
    cases = {"all": (x, y), "two": (x[:, [2, 0]], y), "part": (x[group != 2], y[group != 2]), "noise": (x, other), "constant": (np.column_stack([x[:, 0], np.full(400, 7.0)]), y)}
    for name, (own, label) in cases.items():
        weights, intercept = plain_fit(own, label)
        np.testing.assert_allclose(found[name].weights, weights, rtol=1e-6, atol=1e-9)
        assert found[name].intercept == pytest.approx(intercept, rel=1e-6)
    scores = scored_long(df, {"all": found["all"]}, ["y"]).where("y IS NOT NULL").groupBy("y").agg(F.avg("attack_probability").alias("p")).collect()
    assert {r["y"]: r["p"] > 0.5 for r in scores} == {0: False, 1: True}


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, a double")
    with pytest.raises(ValueError):
        fit_all(df, [Fit("f", ("a",), F.lit(True), F.col("y"))])


def test_separable_classes_converge(spark):
    df = spark.createDataFrame([(int(i > 10), float(i)) for i in range(20)], "y int, a double")
    weights, intercept = plain_fit(np.arange(20.0)[:, None], (np.arange(20) > 10).astype(int))
    found = fit_all(df, [Fit("f", ("a",), F.lit(True), F.col("y"))])["f"]
    assert found.weights[0] == pytest.approx(weights[0], rel=1e-6) and found.intercept == pytest.approx(intercept, rel=1e-6)
